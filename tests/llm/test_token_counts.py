from pyspark.sql import functions as F

from helpers import documents
from varkit.llm.common import scratch
from varkit.llm.token_counts import Ledger, later_copies, signed, state

NONE = "struct<source:string,lang:string,tokenizer_version:string,n_chars:bigint,n_tokens:bigint>"


def _rows(ledger):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_chars, r.n_tokens) for r in ledger.totals().collect()}


def test_batches_are_signed_and_idempotent(spark):
    docs = documents(spark, [(1, "a b", "en", "s"), (2, "c", "en", "s"), (2, "c", "en", "s"), (3, None, None, None)])
    old = state("source", "lang", F.lit("v1"), F.col("n_chars"), F.col("n_chars") * 2)
    new = state("source", "lang", F.lit("v2"), F.col("n_chars"), F.lit(None))
    none = F.lit(None).cast(NONE)
    ledger = Ledger(spark, scratch(spark, "test-ledger"))
    assert _rows(ledger) == {}
    insert = docs.select(none.alias("old"), old.alias("new"))
    assert ledger.commit("a", insert) and not ledger.commit("a", insert)
    assert _rows(ledger) == {("s", "en", "v1"): (3, 5, 10), (None, None, "v1"): (1, 0, 0)}
    assert ledger.commit("b", docs.where("doc_id = 1").select(old.alias("old"), new.alias("new")))
    assert ledger.commit("c", docs.where("doc_id = 3").select(old.alias("old"), none.alias("new")))
    assert ledger.commit("d", insert.limit(0))
    want = {("s", "en", "v1"): (2, 2, 4), ("s", "en", "v2"): (1, 3, 0)}
    assert _rows(ledger) == want
    ledger.compact()
    assert _rows(ledger) == want and not ledger.commit("b", insert)
    assert ledger.commit("e", docs.where("doc_id = 1").select(new.alias("old"), none.alias("new")))
    assert _rows(ledger) == {("s", "en", "v1"): (2, 2, 4)}


def test_unfinished_folders_and_manifests_count_nothing(spark):
    docs = documents(spark, [(1, "a b", "en", "s")])
    ledger = Ledger(spark, scratch(spark, "test-ledger"))
    change = docs.select(F.lit(None).cast(NONE).alias("old"), state("source", "lang", F.lit("v"), F.col("n_chars"), F.lit(1)).alias("new"))
    signed(change).write.parquet(f"{ledger.path}/data/a-crashed")
    ledger._fs.mkdirs(ledger._at("batches/a"))
    ledger._fs.mkdirs(ledger._at("commits"))
    out = ledger._fs.create(ledger._at("commits/a"), False)      # the writer died before the line break
    out.write(bytearray(b"data/a-cra"))
    out.close()
    assert _rows(ledger) == {} and not ledger.is_committed("a")
    assert ledger.commit("a", change) and _rows(ledger) == {("s", "en", "v"): (1, 3, 1)}
    assert not ledger._create("commits/a", ["data/other"])       # a second writer comes too late
    assert _rows(ledger) == {("s", "en", "v"): (1, 3, 1)}


def test_compaction_removes_what_it_folds_and_survives_a_crash(spark, monkeypatch):
    docs = documents(spark, [(1, "a b", "en", "s")])
    ledger = Ledger(spark, scratch(spark, "test-ledger"))
    change = docs.select(F.lit(None).cast(NONE).alias("old"), state("source", "lang", F.lit("v"), F.col("n_chars"), F.lit(1)).alias("new"))
    for name in "abc":
        ledger.commit(name, change)
    monkeypatch.setattr(Ledger, "_retire", lambda self, folded: None)
    ledger.compact()
    assert _rows(ledger) == {("s", "en", "v"): (3, 9, 3)} and not ledger.commit("b", change)
    monkeypatch.undo()
    ledger.commit("d", change)
    ledger.compact()
    assert _rows(ledger) == {("s", "en", "v"): (4, 12, 4)}
    assert ledger._names("commits") == [] and ledger._names("folded") == list("abcd") and len(ledger._names("data")) == 1
    assert not any(ledger.commit(name, change) for name in "abcd")


def test_deleted_copies_take_their_characters_with_them(spark):
    docs = spark.createDataFrame([(5, "x"), (3, "x"), (9, "x"), (None, "x"), (4, "y"), (None, "z"), (3, "x")], "doc_id long, digest string")
    assert sorted(r.doc_id for r in later_copies(docs, "doc_id", "digest").collect()) == [5, 9]
