"""BPE encoding and decoding by a tokenization automaton.

The merges of a byte-level BPE vocabulary are compiled into a deterministic automaton over
tokens, one gadget per merge in order of rank.  The automaton starts as a single state with a
loop for every byte.  The gadget of the merge (a, b) -> c

* copies the state that a leads to, without its arc b, and lets all arcs a lead to the copy, and
* adds an arc c to every state that has an arc a, leading to where b leads at that time.

All arcs with the same label lead to the same state throughout, so a gadget is one new state
(``parent``, the arc taken away, its rank) and one entry of ``target``, and compiling takes one
pass over the merges.  The language is exactly the set of tokenizations that BPE produces: every
byte string has one accepting path.  An arc x leaves a state unless one of the gadgets on the
state's chain took away the part of x (on its left spine) that existed at that time.

Encoding a pre-split word drives two tables over its bytes: the trie of arc labels and the arcs
of the current state.  A prefix of a word has one path at most.
Decoding emits the labels of the ids' arcs.

Words are found with the pattern of the byte-level pre-tokenizer.  Encoded words are memorised
per worker process; the memory's size is bounded and has no influence on results.

Edge cases: NULL text is empty and gives no ids; special tokens' strings in a text become their
ids, as in the tokenizers library; truncation and padding are not applied.  Texts and words of any length are encoded whole.
Rows are independent, so repeated rows and ids are encoded one by one; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varkit.llm.common import worker_cache

# Unicode White_Space, and the pre-tokenizer's pattern.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+")
#: White space other than a line's end that is rare enough to look for with a pattern.
RARE_WHITE_THEN_SPACE = re.compile("[\t\x0b\x0c\r\x85\xa0  -     　] ")

#: Entries of the memories before they are emptied.
CHUNKS_KEPT, ARCS_KEPT, LACKING_KEPT = 250_000, 300_000, 500_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 onwards in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    """States are numbered from 0, the start; ``target[label]`` is where arcs ``label`` lead."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letter = byte_letters()
        self.labels: dict[int, bytes] = {i: bytes(letter[c] for c in t) for t, i in vocab.items()}
        n = max(self.labels) + 1
        self.target = [0] * n
        self.left: list[int] = [-1] * n
        self.born = [-1] * n            # rank of the merge that made the label; -1 for bytes
        self.parent, self.lacks, self.since = [0], [-1], [-1]
        for rank, (x, y) in enumerate(merges):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            if self.born[c] >= 0:
                raise ValueError("two merges make the same token")
            self.left[c], self.born[c] = a, rank
            self.target[c] = self.target[b]
            self.parent.append(self.target[a])
            self.lacks.append(b)
            self.since.append(rank)
            self.target[a] = len(self.parent) - 1
        self._gone: dict[int, dict[int, int]] = {0: {}}
        self._gone_size = 0
        self._arcs: dict[int, bool] = {}
        self._trie()

    def _trie(self) -> None:
        """Trie of the labels: ``step[node << 8 | byte]`` and the label that ends at a node."""
        self.step: dict[int, int] = {}
        self.ends = [-1]
        reachable = [i for i in self.labels if self.born[i] >= 0 or len(self.labels[i]) == 1]
        for i in reachable:
            node = 0
            for byte in self.labels[i]:
                key = node << 8 | byte
                nxt = self.step.get(key)
                if nxt is None:
                    nxt = self.step[key] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i

    def _lacking(self, state: int) -> dict[int, int]:
        """Arcs that the gadgets on the state's chain took away, with their ranks."""
        gone = self._gone.get(state)
        if gone is None:
            chain = []
            while state not in self._gone:
                chain.append(state)
                state = self.parent[state]
            gone = dict(self._gone[state])
            for s in reversed(chain):
                gone[self.lacks[s]] = self.since[s]
            if self._gone_size > LACKING_KEPT:
                self._gone, self._gone_size = {0: {}}, 0
            self._gone[chain[0]] = gone
            self._gone_size += len(gone)
        return gone

    def has_arc(self, state: int, label: int) -> bool:
        key = state << 20 | label
        known = self._arcs.get(key)
        if known is None:
            gone, upper = self._lacking(state), len(self.since)
            x, known = label, True
            while x >= 0:
                rank = gone.get(x)
                if rank is not None and rank <= upper:  # equal: the gadget of a merge of a with itself
                    known = False
                    break
                x, upper = self.left[x], self.born[x]
            if len(self._arcs) >= ARCS_KEPT:
                self._arcs.clear()
            self._arcs[key] = known
        return known

    def _matches(self, word: bytes, i: int) -> list[tuple[int, int]]:
        """(end, label) of the arc labels that the word has at ``i``, shortest first."""
        out, node, step, ends = [], 0, self.step.get, self.ends
        for j in range(i, len(word)):
            node = step(node << 8 | word[j])
            if node is None:
                break
            if ends[node] >= 0:
                out.append((j + 1, ends[node]))
        return out

    def encode(self, word: bytes) -> list[int]:
        """Labels of the word's accepting path.  Long arcs are tried first.  A prefix of the word
        has one path at most, so no position is entered twice and the work is linear."""
        n = len(word)
        if not n:
            return []
        seen, path, target, has_arc = bytearray(n + 1), [], self.target, self.has_arc
        choices = [self._matches(word, 0)]
        state = 0
        while True:
            here = choices[-1]
            while here:
                j, label = here.pop()
                if not seen[j] and has_arc(state, label):
                    seen[j] = 1
                    path.append(label)
                    if j == n:
                        return path
                    state = target[label]
                    choices.append(self._matches(word, j))
                    break
            else:
                choices.pop()
                path.pop()
                state = target[path[-1]] if path else 0


class _Chunks(dict):
    """Ids, as bytes, of a text's parts by part; missing ones are encoded.  There are two generations:
    when the young one is full it becomes the old one, and what is used again moves back."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode
        self._old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self._old.get(part)
        if ids is None:
            ids = self._encode(part)
            if len(part) > 64 or "\n" in part:
                return ids
        if len(self) >= CHUNKS_KEPT:
            self._old = dict(self)
            self.clear()
        self[part] = ids
        return ids


class Codec:
    """Encodes texts to ids (bytes of little-endian unsigned 32-bit integers) and back."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre, special = spec["pre_tokenizer"] or {}, spec.get("added_tokens", [])
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        if model.get("ignore_merges") or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special):
            raise ValueError("options of this vocabulary are not supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        names = {t["content"]: t["id"] for t in special}
        self.automaton = Automaton({t: i for t, i in model["vocab"].items() if t not in names}, merges)
        self._special = {t: array("I", [i]).tobytes() for t, i in names.items()}
        self._split = re.compile("(" + "|".join(re.escape(t) for t in sorted(names, key=len, reverse=True)) + ")") if names else None
        self._words = regex.compile(WORD_PATTERN).findall
        self._labels = dict(self.automaton.labels) | {i: t.encode() for t, i in names.items()}
        self._word = _Chunks(lambda word: array("I", self.automaton.encode(word.encode())).tobytes())
        self._plain = _Chunks(self._encode_words)
        self._spaced = _Chunks(lambda part: self._encode_words(" " + part))

    def _encode_words(self, text: str) -> bytes:
        if text.removeprefix(" ").isalpha():
            return array("I", self.automaton.encode(text.encode())).tobytes()
        return b"".join(map(self._word.__getitem__, self._words(text)))

    def encode(self, text: str) -> bytes:
        if self._split is not None and any(t in text for t in self._special):
            return b"".join(self._special.get(part) or self._segment(part) for part in self._split.split(text) if part)
        return self._segment(text)

    def _segment(self, text: str) -> bytes:
        # Words never reach across a space that follows a character other than white space, so
        # the text may be cut before each space; runs of white space are left in one piece.
        if "  " in text or "\n " in text or RARE_WHITE_THEN_SPACE.search(text):
            return self._encode_words(text)
        first, *rest = text.split(" ")
        return b"".join([self._plain[first] if first else b"", *map(self._spaced.__getitem__, rest)])

    def decode(self, ids: bytes) -> str:
        """The labels of the ids, in order; ids that the vocabulary lacks emit nothing."""
        numbers = array("I")
        numbers.frombytes(ids)
        try:
            found = list(map(self._labels.__getitem__, numbers))
        except KeyError:
            found = [self._labels.get(i, b"") for i in numbers]
        return b"".join(found).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, compiled once per worker process."""
    cache = worker_cache()
    if ("bpe", path) not in cache:
        cache["bpe", path] = Codec(path)
    return cache["bpe", path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids`` (bytes, if asked for), ``ids_sha256`` and
    ``decoded_sha256``, the digest of the text that the ids decode to.  ``path`` is a vocabulary file that every
    worker can read."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches):
        c = codec(path)
        for b in batches:
            ids = [c.encode(t.as_py()) for t in b.column(1)]
            out = {id_col: b.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                   "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                   "decoded_sha256": pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string())}
            if with_ids:
                out["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row the id and ``text``, decoded from ids as ``encode_documents`` gives them."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py()) for x in b.column(1)], pa.string())], [id_col, "text"])

    rows = encoded.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{ids_col}`"), F.lit(b"")).alias("_ids"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, text string")
