"""Every registered query of the engine with SQL against DuckDB on the same tables."""

import os
from pathlib import Path

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")
from onetask import KthNeighbour, LocalOutlierFactor, Reduced  # noqa: E402

from tidewatch import registry  # noqa: E402
from tidewatch.operators import detectors, outliers, windows  # noqa: E402
from tidewatch.plans import catalogue  # noqa: E402
from tidewatch.sources.driver import EVENTS_SQL  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame, columns):
    out = frame[columns].copy()
    for c in columns:
        if out[c].dtype.kind in "fiub":
            out[c] = out[c].astype(float).round(6)
        out[c] = out[c].astype(object).where(out[c].notna(), None)
    return sorted(map(tuple, out.astype(str).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours = registry.QUERIES[name](spark, DATA).toPandas()
    theirs = duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


# -- queries that SQL cannot say: each against numbers made otherwise, on the same tables -------------------------


def fetched(duck, sql):
    return duck.execute(f"WITH {EVENTS_SQL} {sql}").fetchdf()


def periods(spark, duck):
    got = {r.domain: r for r in registry.QUERIES["beacon_periods"](spark, DATA).collect()}
    ev = fetched(duck, "SELECT domain, us FROM ev")
    assert set(got) == set(ev.domain)
    for domain, part in ev.groupby("domain"):
        bins = ((part.us - part.us.min()) // 3_600_000_000).to_numpy()
        x = np.bincount(bins[bins < 43_200]).astype(float)
        power = np.abs(np.array([np.sum((x - x.mean()) * np.exp(-2j * np.pi * k * np.arange(len(x)) / len(x))) for k in range(1, len(x) // 2 + 1)])) ** 2
        k = int(power.argmax()) + 1
        assert got[domain].period_s == pytest.approx(len(x) * 3600 / k) and got[domain].strength == pytest.approx(power[k - 1] / power.sum())


def residuals(spark, duck):
    got = {(r.domain, r.bucket_us): r.z for r in registry.QUERIES["seasonal_residuals"](spark, DATA).collect()}
    ev = fetched(duck, "SELECT domain, us // 3600000000 AS h, count(*) AS n FROM ev GROUP BY 1, 2 ORDER BY 1, 2")
    want = {}
    for domain, part in ev.groupby("domain"):
        at = (part.h - part.h.iloc[0]).to_numpy()
        if at[-1] + 1 < 72:
            continue
        y = np.zeros(int(at[-1]) + 1)
        y[at] = part.n
        r = detectors.seasonal_residuals(y, (24, 168) if len(y) >= 336 else (24,))[at]
        z = (r - r.mean()) / r.std()
        want |= {(domain, int(h) * 3_600_000_000): v for h, v in zip(part.h, z, strict=True) if abs(v) > 3}
    assert got == pytest.approx(want)


def names(spark, duck):
    rows = registry.QUERIES["generated_names"](spark, DATA).collect()
    right = [(r.score >= 0.5) == (r.y == 1) for r in rows]
    assert {r.y for r in rows} == {0, 1} and np.mean(right) > 0.95  # none of them was learned from


def groups(spark, duck):
    found = registry.QUERIES["incidents"](spark, DATA).collect()
    edges = {tuple(sorted((f"{r.src_type}:{r.src}", f"{r.dst_type}:{r.dst}"))) for r in registry.QUERIES["graph_edges"](spark, DATA).collect()}
    every = [n for r in found for n in r.entities]
    assert len(every) == len(set(every)) and found
    nodes = {n for e in edges for n in e}
    bursts = {f"user:{r.entity_value}" for r in registry.QUERIES["burst_user_6h"](spark, DATA).collect() if r.n >= 4}
    assert sorted(s for r in found for s in r.seeds) == sorted(bursts & nodes)
    for r in found:
        assert set(r.seeds) <= set(r.entities) and r.incident_id == min(r.entities)
        reached, todo = set(), [r.entities[0]]
        while todo:  # a community hangs together
            n = todo.pop()
            if n not in reached:
                reached.add(n)
                todo += [m for m in r.entities if tuple(sorted((n, m))) in edges]
        assert reached == set(r.entities)


def summaries(spark, duck):
    got = {r.incident_id: r.summary for r in registry.QUERIES["incident_summaries"](spark, DATA).collect()}
    o = duck.execute("SELECT o_custkey % 50 AS i, substr(o_orderpriority, 1, 1) AS d, o_orderkey AS k FROM orders").fetchdf()
    for i, part in o.groupby("i"):
        d = sorted(set(part.d))
        n, e = len(part), len(d)
        listed = d[0] if e == 1 else " and ".join(d) if e == 2 else ", ".join(d[:-1]) + ", and " + d[-1]
        assert got[i] == f"{n} signal{'' if n == 1 else 's'} on {'1 entity' if e == 1 else f'{e} entities'}. Raised by {listed}. It spans {part.k.max() * 1e6 / 3.6e9:,.1f} hours."


def model(kind):
    """Scores by forms that hold all rows in one task, confidences by counting."""

    def check(spark, duck):
        got = {r.vec_id: r for r in registry.QUERIES[f"outliers_{kind}"](spark, DATA).collect()}
        rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
        ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
        early = ids <= ids.min() + (ids.max() - ids.min()) * 0.9
        mean, sd = x[early].mean(0), x[early].std(0)
        z = (x - mean) / sd
        if kind in outliers.MODELS:
            d = outliers.fitted(catalogue._vectors(spark, DATA), [kind], order="vec_id")[kind]
            assert np.allclose(d.scale.mean, mean) and np.allclose(d.scale.sd, sd)
            s = d.model.scores(z)
        elif kind == "mahalanobis":
            base = z[early]
            lower = lambda v, q: np.quantile(v, q, axis=0, method="inverted_cdf")
            far = np.abs(base - lower(base, 0.5)).sum(1)
            for _ in range(10):
                kept = base[far <= lower(far, 0.75)]
                centre, precision = kept.mean(0), np.linalg.inv(np.cov(kept.T) + 1e-6 * np.eye(base.shape[1]))
                far = np.sqrt(np.einsum("ij,jk,ik->i", base - centre, precision, base - centre))
            s = np.sqrt(np.einsum("ij,jk,ik->i", z - centre, precision, z - centre))
        else:
            s = Reduced(z[early], KthNeighbour if kind == "kth_nn_pca" else LocalOutlierFactor).scores(z)
        late = np.sort(s[~early])
        for i, v in zip(ids, s, strict=True):
            assert got[i].raw_score == pytest.approx(v, abs=2e-6) and abs(got[i].confidence - np.searchsorted(late, v + 1e-9, "right") / len(late)) <= 1.01 / len(late)

    return check


def windows_reported(spark, duck):
    rows = registry.QUERIES["window_outliers"](spark, DATA).collect()
    assert all(r.confidence >= 0.995 and len(set(r.contributions)) == 10 and set(r.contributions) <= set(windows.FEATURES) for r in rows)
    total = registry.QUERIES["entity_vectors"](spark, DATA).count()
    assert 0 < len(rows) < 0.1 * total


CHECKS = {"beacon_periods": periods, "seasonal_residuals": residuals, "generated_names": names, "incidents": groups, "incident_summaries": summaries, "window_outliers": windows_reported} | {f"outliers_{k}": model(k) for k in ("eif", "iforest", "mahalanobis", "kth_nn_pca", "lof_pca")}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_without_sql(spark, duck, name):
    CHECKS[name](spark, duck)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
