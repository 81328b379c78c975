import array
import hashlib

import corpus_pipeline as P
from helpers import DOCS, WORD, base_figures, near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    from varkit.llm.mixing import targets
    from varkit.llm.queries import byte_bpe_path
    from tokenizers import Tokenizer
    docs = spark.read.parquet(SF + "/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    (n1, quality), (n2, near), (n3, mixing), (n4, bpe) = P.STAGES

    kept = quality(spark, docs, SF)
    assert kept.columns == docs.columns
    k = {r.doc_id: r for r in kept.collect()}
    assert all(k[i] == before[i] for i in k)
    for i, r in before.items():
        n, _, _, _, rep = base_figures(r.text)
        assert not (i in k and (n < 10 or 100 * rep > 20 * n))

    groups = near_duplicates([(i, r.text) for i, r in k.items()])
    one = near(spark, kept, SF)
    assert one.columns == docs.columns
    o = {r.doc_id: r for r in one.collect()}
    assert set(o) == {c for _, c in groups.values()} and all(o[i] == k[i] for i in o)

    mixed = mixing(spark, one, SF)
    assert mixed.columns == docs.columns
    sizes, took = {}, {}
    for r in o.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    names = sorted(sizes)
    goal = dict(zip(names, targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    rows = mixed.collect()
    for r in rows:
        took[r.source] = took.get(r.source, 0) + len(WORD.findall(r.text))
        assert set(WORD.findall(r.text)) <= set(WORD.findall(o[r.doc_id].text)) and r.n_chars == len(r.text)
    assert {s: round(g) for s, g in goal.items()} == took

    library = Tokenizer.from_file(byte_bpe_path())
    want = sorted((r.doc_id, hashlib.sha256(array.array("I", library.encode(r.text, add_special_tokens=False).ids).tobytes()).hexdigest()) for r in rows)
    assert sorted((r.doc_id, r.ids_sha256) for r in bpe(spark, mixed, SF).collect()) == want
    assert sorted((r.doc_id, r.ids_sha256) for r in P.run(spark, SF).collect()) == want


def test_stages_take_empty_and_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "a " * 30, "xx", None, 60), (2, "word", "en", "s", 4)], DOCS)
    for df in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            assert stage(spark, df, SF).count() >= 0
