"""Every query with SQL against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from flowloom.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    plain = lambda v: None if pd.isna(v) else round(float(v), 4) if isinstance(v, float) else v.item() if hasattr(v, "item") else v if isinstance(v, (str, bool, int)) else str(v)
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_byte_entropy_of_every_text(spark, tmp_path):
    texts = ["ab", "", "x" * 2000 + "y" * 2000, "é" * 1500, "".join(chr(33 + i % 90) for i in range(30_000)), None]
    rows = [(i, t, None if i == 0 else len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["entropy"] for r in QUERIES["byte_entropy_text"](spark, str(tmp_path)).collect()}
    share = lambda b: [b.count(c) / len(b) for c in set(b)]
    want = {i: round(-sum(p * math.log2(p) for p in share((t or "").encode())), 4) for i, t in enumerate(texts)}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-4 for i in want)


def test_line_items_of_one_number_are_all_segments(spark, tmp_path):
    # (order, line number, part, supplier): offset part % 7 * 3, length 1 + supplier % 9; order 1 has line number 1 three times
    items = [(1, 1, 7, 2), (1, 1, 1, 2), (1, 1, 2, 5), (1, 2, 1, 4), (2, 3, 5, 0), (2, 3, 0, 8), (2, 1, 3, 1)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    flows = {}
    for o, n, p, s in sorted(items):
        flows.setdefault(o, []).append((p % 7 * 3, 1 + s % 9, p % 3 == 0))
    want = {name: set() for name in ("tcp_out_of_order", "tcp_contiguous_prefix", "tcp_holes", "tcp_retransmit_bytes", "tcp_reassemble", "frag_complete")}
    prefix = lambda seen: next(i for i in range(len(seen) + 1) if i not in seen)
    for o, segs in flows.items():
        seen, again = set(), 0
        for i, (off, n, _) in enumerate(segs):
            want["tcp_out_of_order"].add((o, i + 1, bool(seen) and off <= max(seen)))
            again += len(seen & set(range(off, off + n)))
            seen |= set(range(off, off + n))
        want["tcp_retransmit_bytes"].add((o, again))
        want["tcp_contiguous_prefix"].add((o, prefix(seen)))
        edges = [-1, *sorted(seen)]
        want["tcp_holes"] |= {(o, a + 1, b) for a, b in zip(edges, edges[1:]) if b > a + 1}
        base = segs[0][0]
        end = prefix({x for off, n, _ in segs if off >= base for x in range(off - base, off - base + n)})
        want["tcp_reassemble"].add((o, end, "61" * end, len(segs)))
        total = max((off + n for off, n, last in segs if last), default=-1)
        want["frag_complete"].add((o, len(segs), total, total >= 0 and prefix(seen) >= total))
    columns = {"tcp_out_of_order": "flow, pkt_no, out_of_order", "tcp_holes": "flow, hole_start, hole_end", "tcp_reassemble": "flow, contiguous_end, data_hex, segments", "frag_complete": "flow, n_fragments, total_len, complete"}
    for name, rows in want.items():
        got = QUERIES[name](spark, str(tmp_path))
        got = got.select(*columns[name].split(", ")) if name in columns else got
        assert sorted(tuple(r) for r in got.collect()) == sorted(rows), name


@pytest.mark.parametrize(("name", "costly"), [("dot11_frame", "unhex("), ("tcp_options", "unhex("), ("smtp_roundtrip", "split(")])
def test_payload_is_worked_out_once(spark, name, costly):
    """Inside a lambda an expression that is written twice is evaluated twice, so the plan has it once."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(costly) == 1
