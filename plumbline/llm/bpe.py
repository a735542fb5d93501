"""BPE encoding and decoding in batched numpy merge rounds.

Each task reads Arrow batches of whole texts. The words of a batch that have not
been met before are laid out as one flat symbol array. A round looks every
neighbouring pair up by binary search over the sorted pair keys, takes the
lowest-rank pair of each word and merges all its places at once; a word without
a further pair leaves the array. Token ids are then gathered for every text.

The work is one narrow scan: no shuffle, and per task only one batch of texts
plus a cache of encoded words (at most CACHE_WORDS; emptied when full, which
costs time and changes nothing).

Defined results: null is the empty text, which has no tokens; repeated rows get
one result each; a null id is kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoded words a task keeps for later batches.
CACHE_WORDS = 200_000
#: Characters of text that are encoded together.
CHUNK_CHARS = 1 << 21


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE
    files: printable Latin-1 bytes are themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A word-level BPE file: words found by a pattern in normalised text, their
    UTF-8 bytes as symbols, the last one marked as word end, then merges."""

    def __init__(self, spec: str | dict):
        d = json.loads(spec) if isinstance(spec, str) else spec
        model = d["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = np.empty(size, dtype=object)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.width = size
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        steps = d["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special token is a word of its own."""
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.split.split(text)
        return reduce(lambda out, p: out + ([p] if p in self.special else self._plain(p)), parts, [])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # Lower case is taken character by character, so the final sigma of
            # a word is an ordinary one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def encode(self, words: list[str]) -> list[bytes]:
        """Token ids of each word, as little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(w) for w in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[flat]
        sym[ends - 1] = self.final[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        while sym.size:
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.ranks[at], self.ranks.size), self.ranks.size)
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(start, word.size))
            best = np.repeat(np.minimum.reduceat(rank, start), length)
            alive = best < self.ranks.size
            if not alive.all():
                done_sym.append(sym[~alive])
                done_word.append(word[~alive])
            pick = alive & (rank == best)
            # Of overlapping places (a run of one symbol) every second one merges.
            where = np.flatnonzero(pick)
            if where.size:
                first = np.append(True, (np.diff(where) != 1) | (word[where[1:]] != word[where[:-1]]))
                run = np.maximum.accumulate(np.where(first, where, 0))
                where = where[(where - run) % 2 == 0]
                sym = sym.copy()
                sym[where] = self.made[at[where]]
                alive[where + 1] = False
            sym, word = sym[alive], word[alive]
        if not done_sym:
            return []
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        ids = sym[order].astype("<u4").tobytes()
        cut = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]) * 4
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by spaces (the file names no decoder)."""
        return " ".join(self.tokens[ids].tolist())


def encode_texts(bpe: WordBpe, texts: list[str | None], cache: dict[str, bytes]) -> Iterator[bytes]:
    """Token ids of each text, new words encoded together chunk by chunk."""
    if not cache:
        cache.update({t: np.array([i], "<u4").tobytes() for t, i in bpe.special.items()})
    chunk: list[list[str]] = []
    chars = 0
    for n, text in enumerate(texts):
        chunk.append(bpe.words(text) if text else [])
        chars += len(text or "")
        if chars < CHUNK_CHARS and n + 1 < len(texts):
            continue
        new = list({w for ws in chunk for w in ws if w not in cache})
        cache.update(zip(new, bpe.encode(new), strict=True))
        for ws in chunk:
            yield b"".join([cache[w] for w in ws])
        chunk, chars = [], 0
        if len(cache) > CACHE_WORDS:
            cache.clear()
            cache.update({t: np.array([i], "<u4").tobytes() for t, i in bpe.special.items()})


def _spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenize(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
             with_ids: bool = True) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``token_ids`` (array, if
    ``with_ids``), ``ids_sha256`` and ``decoded_sha256`` of the ids decoded
    again. The vocabulary file (a fixed size) is read once on the driver and
    travels with the tasks."""
    spec = _spec(vocab_path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = WordBpe(spec), {}
        for batch in batches:
            n, ids, raw, back = [], [], [], []
            for b in encode_texts(bpe, batch.column(1).to_pylist(), cache):
                a = np.frombuffer(b, "<u4")
                n.append(a.size)
                raw.append(hashlib.sha256(b).hexdigest())
                back.append(hashlib.sha256(bpe.decode(a).encode("utf-8")).hexdigest())
                if with_ids:
                    ids.append(a.astype(np.int32))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(raw, pa.string()), pa.array(back, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return df.select(id_col, text_col).mapInArrow(run, schema + ", token_ids array<int>" * with_ids)


def detokenize(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """One row per input row: id and ``decoded`` text; null ids give null."""
    spec = _spec(vocab_path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(spec)
        for batch in batches:
            text = [None if x is None else bpe.decode(np.array(x, dtype=np.int64))
                    for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], [id_col, "decoded"])

    return df.select(id_col, F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, decoded string")
