import zlib

import numpy as np
import pytest

from helpers import documents
from varkit.llm import token_files as T
from varkit.llm.common import scratch


@pytest.mark.parametrize("case", [
    [[5]], [[0] * 9, [49407] * 9], "random", "skewed", "mixed"])
def test_coder_round_trip(case):
    rng = np.random.default_rng(1)
    blocks = {"random": [rng.integers(0, 49408, 3000)], "skewed": [rng.zipf(1.3, 5000) % 49408 for _ in range(9)],
              "mixed": [rng.integers(0, 5, 8192), np.arange(300) % 7, np.array([1]), rng.integers(0, 49408, 700)]}.get(case) if isinstance(case, str) else [np.array(x) for x in case]
    codes = T.encode_blocks(blocks, 49408)
    for a, b in zip(blocks, T.decode_blocks(codes, [len(x) for x in blocks], 49408)):
        assert (a == b).all()
    # each block is decoded alone as well
    assert (T.decode_blocks(codes[-1:], [len(blocks[-1])], 49408)[0] == blocks[-1]).all()
    if case == "skewed":
        assert sum(map(len, codes)) < 0.8 * sum(2 * len(b) for b in blocks)


def test_one_distribution_is_coded():
    """The shares of all ids under one mixture sum to one: an id costs the sum of its three predictions, so copies of a
    passage cost next to nothing and ids that no order knows cost what order 0 gives them."""
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 49408, 256)
    once, often = (sum(map(len, T.encode_blocks([np.tile(passage, k)], 49408))) for k in (1, 30))
    assert often < once + 29 * 256 * 0.1
    # a stream drawn from few ids costs little more than its entropy, here 3 bits an id
    few = rng.choice(rng.integers(0, 49408, 8), 8192)
    assert len(T.encode_blocks([few], 49408)[0]) < 8192 * 3.4 / 8
    c = T.order0(few[:2000], T.prior(49408))
    assert (np.diff(c) > 0).all() and c[-1] < 1 << T.LANE_BITS


def test_order0_goes_on_learning_to_the_end_of_a_block():
    """Ids that come up only in the second half of a block are learnt there."""
    rng = np.random.default_rng(4)
    late = np.concatenate([rng.integers(0, 50, 4096), rng.integers(1000, 1050, 4096)])
    assert T.renewals(8192)[-1] == 7168 and len(T.encode_blocks([late], 49408)[0]) < 8192 * 8.5 / 8


def test_checksums_join():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (3, 0), (7, 1), (1000, 123_457)):
        a, b = rng.bytes(n), rng.bytes(m)
        assert T.crc32_join(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def _expected(rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return t.get_vocab_size(with_added_tokens=True), [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for _, x in rows]


def test_files_and_documents(spark):
    import public_tokenizers
    rows = [(7, "The Garden, the river's end."), (2, None), (3, ""), (9, "long words " * 3000), (1, "ÀÉ ß 漢字 <|endoftext|> x\x1cy\x85z İ ΑΣ é!"), (12, "  \n"), (4, "###the&&& 12 3.5 ٣")]
    size, want = _expected(rows)
    path = scratch(spark, "test-tokens")
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3)
    T.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), block_tokens=500)
    got = {r.id: r for r in T.read_documents(spark, path, size).collect()}
    start = 0
    for (i, _), ids in sorted(zip(rows, want), key=lambda x: x[0][0]):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), i
        start += len(ids)
    parts = {}
    for r in T.read_segments(spark, path, size, with_ids=True).orderBy("part", "block", "doc_no").collect():
        parts.setdefault(r.id, []).extend(r.ids)
    assert all(parts[i] == list(ids) for (i, _), ids in zip(rows, want))


def test_null_and_repeated_ids_and_empty_table(spark):
    import public_tokenizers
    tok = public_tokenizers.path("word_bpe_49k.json")
    path = scratch(spark, "test-tokens")
    T.write_token_files(documents(spark, [(None, "a b", "en", "s"), (1, "x", "en", "s"), (1, "x", "en", "s"), (1, "yy zz", "en", "s")]), path, tok)
    got = sorted((r.start, str(r.id), r.n_tokens) for r in T.read_documents(spark, path, 49408).collect())
    assert [x[0] for x in got] == [0, 3, *np.cumsum([x[2] for x in got[1:]])[:2] + 3] and got[0][1] == "None" and len(got) == 4
    path = scratch(spark, "test-tokens")
    T.write_token_files(documents(spark, [(None, "a", "en", "s"), (2**53 + 1, "x " * 9000, "en", "s"), (2**53 + 3, "y", "en", "s")]).coalesce(1), path, tok)
    assert {str(r.id) for r in T.read_documents(spark, path, 49408).collect()} == {"None", str(2**53 + 1), str(2**53 + 3)}
    path = scratch(spark, "test-tokens")
    T.write_token_files(documents(spark, []), path, tok)
    assert T.read_documents(spark, path, 49408).count() == 0


def test_damage_is_found(spark):
    ids = np.arange(600) % 50
    code = T.encode_blocks([ids], 49408)[0]
    payload = bytearray(T.pack(ids, code, [(1, 600, True, True)], 0))
    payload[-40] ^= 255
    path = scratch(spark, "test-tokens")
    spark.createDataFrame([(0, 0, bytes(payload))], "part int, block long, payload binary").write.parquet(path)
    with pytest.raises(Exception, match="damaged"):
        T.read_segments(spark, path, 49408).collect()


def test_query(spark):
    from varkit.llm.queries import op2
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(sf + "/documents.parquet").collect())
    _, want = _expected(rows)
    got = {r.doc_id: r for r in op2(spark, sf).collect()}
    start = 0
    for (i, _), ids in zip(rows, want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_order0_of_both_coders_is_that_of_all_ids():
    """The tables by local number give every id the weight that ``order0`` gives it, without overlap, and grow with the
    ids of a block, not with the vocabulary."""
    rng = np.random.default_rng(5)
    ids = rng.zipf(1.2, 700) % 49408
    base = T.prior(49408)
    line = np.concatenate([[0], np.cumsum(base)])
    local, names = T._numbered(ids, np.zeros(49408, np.int64))
    assert (names[local - 1] == ids).all() and list(names) == list(dict.fromkeys(ids.tolist()))
    row, begin, weight, total = T._spread(local, names, [0, 64, 512], base, line)
    for t, seen in ((0, 0), (64, 64), (512, 512)):
        c = T.order0(ids[:seen], base)
        of = slice(row[t] + 1, row[t] + 1 + len(names))
        assert (weight[of] == np.diff(c)[names]).all() and total[t] == c[-1]
        by = np.argsort(begin[of])
        assert ((begin[of] + weight[of])[by][:-1] <= begin[of][by][1:]).all() and (begin[of] + weight[of]).max() <= total[t]
    lanes = T._Lanes(2, 49408, 700)
    lanes.last[:] = k = len(names)
    lanes.names, lanes.counts, lanes.spans = (np.zeros((2, k + 2), np.int64) for _ in range(3))
    lanes.cap, lanes.names[:, 1:k + 1] = k + 2, names
    lanes._room()
    lanes.renew(700, np.stack([local, local], 1))
    c = T.order0(ids, base)
    span = lanes.span[lanes.row[1] + 1:lanes.row[1] + 1 + k]
    assert (span >> 32 == np.diff(c)[names]).all() and (lanes.total == c[-1]).all() and len(lanes.table) == 2 * (k + 2)
    assert (lanes.find(np.array([0, c[-1] - 1]))[0], (lanes.find((span & 0xFFFFFFFF)[[k - 1, k // 2]]) == [k, k // 2 + 1]).all()) == (1, True)
    # the places behind them are those of the other ids, in ascending order
    others = np.setdiff1d(np.arange(49408), names)
    ends = lanes.rest[0] + np.cumsum(base[others])
    for i in (0, 1, 777, len(others) - 1):
        got = lanes.others(np.array([0]), np.array([ends[i] - 1]))
        assert lanes.name[lanes.row[0] + got[0]] == others[i]


def test_blocks_of_all_lengths_in_any_order():
    rng = np.random.default_rng(6)
    blocks = [rng.integers(0, 400, k) for k in (3, 2000, 1, 65, 2000, 64, 1025)]
    back = T.decode_blocks(T.encode_blocks(blocks, 49408), [len(b) for b in blocks], 49408)
    assert all(len(a) == len(b) and (a == b).all() for a, b in zip(blocks, back))
    # one block whose order-0 tables grow from place to place
    wide = rng.permutation(49408)[:9000]
    assert (T.decode_blocks(T.encode_blocks([wide], 49408), [9000], 49408)[0] == wide).all()


def test_words_that_come_again_are_not_encoded_again(monkeypatch):
    """New words go to the library many at a time, and a full memory keeps what is in use."""
    import public_tokenizers
    monkeypatch.setattr(T, "CHUNKS_KEPT", 50)
    texts, asked = T._Texts(public_tokenizers.path("word_bpe_49k.json"), 1), []
    library = texts._library_words
    monkeypatch.setattr(texts, "_library_words", lambda words: (asked.append(list(words)), library(words)))
    rows = [f"Garden garden, gärten. İx ΑΣ word{'x' * i} {chr(97 + i % 26) * (i + 2)} {chr(97 + i % 26) * (i + 3)}é!!" for i in range(200)]
    want = [[*e.ids, 1] for e in texts.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
    assert [texts.ids(x).tolist() for x in rows] == want
    assert len(asked) <= len(rows) and sum(w.count("garden") + w.count("gärten") for w in asked) == 2
