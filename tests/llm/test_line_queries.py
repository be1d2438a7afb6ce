"""op2 and the line stage of the pipeline against brute force, with lines of every length."""

import hashlib

import corpus_pipeline
from flowloom.llm.queries import op2_line_dedup

LONG = "a line of more than twenty characters"
TEXTS = ["Les.\n\nUn.\n" + LONG, "Un.\n\nx\nLes!\nseven c\n" + LONG[:-1], None, "", "x\nx\nLes.\n\nseven c", "\n", "eight ch\neight ch", LONG + "!"]


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute():
    """Per text: the kept text and the number of lines removed."""
    seen, out = [], []
    for t in TEXTS:
        kept, gone = [], 0
        for line in [] if t is None else t.split("\n"):
            again = line != "" and any(line == s or min(len(line), len(s)) >= 20 and within_one(line, s) for s in seen)
            gone += again
            kept += [] if again else [line]
            seen.append(line)
        out.append((None if t is None else "\n".join(kept), gone))
    return out


def test_every_line_takes_part(spark, tmp_path):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute()
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (n, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, (t, n) in enumerate(want)}
    stage = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert stage == {i: t for i, (t, _) in enumerate(want)}
