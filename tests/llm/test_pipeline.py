"""The corpus pipeline against brute force, each stage on its own input, and the queries' contracts."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_secrets
from test_minhash import brute

import corpus_pipeline
from strataflow.llm import packing, quality
from strataflow.llm.queries import ORACLES, QUERIES
from strataflow.session import table

CONTRACTS = {
    "op1": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op4": {"doc_id": "bigint", "item_id": "bigint"},
    "op5": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op6": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op11": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op12": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op13": dict.fromkeys(("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "bigint") | {"ends_sha256": "string"},
}


@pytest.mark.parametrize("op", sorted(CONTRACTS))
def test_contracts(spark, sf_dir, op):
    (name,) = [n for n in QUERIES if n.startswith(op + "_")]
    got = dict(QUERIES[name](spark, sf_dir).dtypes)
    assert {k: got.get(k) for k in CONTRACTS[op]} == CONTRACTS[op]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = con.sql(ORACLES[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(map(str, r)) for r in got.select(*cols).collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["chat_attachments", "op3_typed_content_parts", "op13_contracted_trie"])
def test_oracles_on_escapes(spark, tmp_path, name):
    import duckdb

    rows = [(1, 0, "user", "a\\b"), (1, 1, "assis\\tant: x", "<|image:0|> \\l # \\\\"), (2, None, None, "### </turn>\\"), (20, 1, "user", ""), (21, 1, "assistant", None), (21, 2, "assistant", "x\\ y " * 5000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want, cols = con.sql(ORACLES[name]), sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(map(str, r)) for r in got.select(*cols).collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def holds(text, item):
    w, i = plain(text), plain(item)
    seen = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    own = [tuple(i[k : k + 5]) for k in range(len(i) - 4)]
    return sum(x in seen for x in own) >= 0.8 * len(own)


def brute_redaction(text):
    spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in brute_secrets(text).split(",") if s))
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out, at = out + text[at:a] + f"[{kind.upper()}]", b
        at = max(at, b)
    return out + text[at:]


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    inputs = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, inputs[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        inputs.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(x.columns == docs.columns for x in inputs[:-1])
    text = [{r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in inputs[:-1]]

    ranking = quality.train(docs, table(spark, sf_dir, "labels"))
    assert set(text[1]) == {r.doc_id for r in quality.score_documents(docs, ranking).where("predicted = 1").collect()}
    assert set(text[2]) == {a for a, b in brute(sorted(text[1].items())) if a == b}
    items = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    assert set(text[3]) == {i for i, t in text[2].items() if not any(holds(t, x) for x in items)}
    assert text[4] == {i: brute_redaction(t) for i, t in text[3].items()}
    assert all(r.n_chars == len(r.text) for r in inputs[4].collect())
    want = Counter(tuple(r) for r in packing.pieces(inputs[4]).drop("salt").collect())
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(r) for r in inputs[5].select(*keys).collect()) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select(*keys).collect()) == want


def test_stages_on_an_empty_table_and_nulls(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
    odd = docs.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    assert corpus_pipeline.quality_stage(spark, odd, sf_dir).count() in (0, 3)
    assert corpus_pipeline.dedup_stage(spark, odd, sf_dir).count() == 1
    assert corpus_pipeline.decontamination_stage(spark, odd, sf_dir).count() == 3
    assert corpus_pipeline.secrets_stage(spark, odd, sf_dir).count() == 3
    assert corpus_pipeline.packing_stage(spark, odd, sf_dir).count() == 3
