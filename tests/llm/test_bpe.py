import array
import hashlib
import random

import pytest

from conftest import SF_SMALL
from helpers import documents
from varkit.llm import bpe
from varkit.llm.queries import byte_bpe_path, op5

PIECES = ["a", "b", "e", "the", " ", "  ", "\n", "\t", " ", "　", "1", "23", "é", "漢", "字", "'s", "'ll", "!", "...", "<|endoftext|>", "\x1c", "\x85", "🙂",
          "aaaa", "hello", "\r\n", "ing", "ST", "́", "ß", "²", "Ⅷ", " the", "_", "$$$", "\n ", " \n", "  "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(byte_bpe_path())


def test_same_ids_and_text_as_the_library(library):
    random.seed(5)
    texts = ["".join(random.choice(PIECES) for _ in range(random.randint(0, 40))) for _ in range(4000)]
    texts += ["", "a" * 5000, "ab" * 3000, " " * 500, "\n \n  x", "aaaaaaa", "x" * 3 + " " * 3, "".join(map(chr, range(1, 0x3000)))]
    c = bpe.Codec(byte_bpe_path())
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = c.encode(t)
        assert list(array.array("I", ids)) == e.ids, repr(t)
        assert c.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_automaton_of_a_small_vocabulary_against_merging_by_hand():
    """All strings up to nine letters, merges that overlap and merge with themselves."""
    import itertools
    merges = [("a", "a"), ("a", "b"), ("aa", "a"), ("ab", "a"), ("b", "b"), ("aa", "ab")]
    vocab = {t: i for i, t in enumerate(list(bpe.byte_letters()) + ["".join(m) for m in merges])}
    machine = bpe.Automaton(vocab, merges)

    def by_hand(word):
        parts = list(word)
        while True:
            found = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
            if not found:
                return [vocab[p] for p in parts]
            rank = min(found)[0]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == merges[rank]:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
    for n in range(10):
        for w in itertools.product("ab", repeat=n):
            assert machine.encode("".join(w).encode()) == by_hand(w), w


def test_query_and_round_trip(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(SF_SMALL + "/documents.parquet").collect()}
    for r in op5(spark, SF_SMALL).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    rows = documents(spark, [(1, None, "en", "s"), (1, "x y", None, None), (None, "z", "en", "s"), (2**53 + 1, "big", "en", "s")]).coalesce(1)
    back = bpe.decode_documents(bpe.encode_documents(rows, byte_bpe_path()), byte_bpe_path()).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == [("1", ""), ("1", "x y"), (str(2**53 + 1), "big"), ("None", "z")]
    assert bpe.encode_documents(rows.limit(0), byte_bpe_path()).count() == 0
