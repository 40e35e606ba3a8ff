"""Bounded-space online best-fit packing of token sequences.

Every partition packs its own texts as they come.  A fixed number of bins is
open; a bitset has a bit for each free space that an open bin has, so the
tightest bin that still fits is the lowest set bit at or above the need.  When
a new bin would exceed the bound, the fullest open bin closes.  Texts come in
slices of SLICE_BYTES, the long pieces of a slice first.  What lies in the bins that a
partition ends with is packed once more, with that of the 63 partitions beside
it, so that a table in many partitions wastes no more than one in few.  Texts
are never shuffled, and memory is bounded by the number of open bins.

Token ids: a text is cut where no token can reach across (ASCII white space,
which the vocabulary drops, and between letters, digits and signs); ids of the
parts are kept in a bounded table.

Cases: a null or empty text is the single end id; longer documents are cut into
pieces of the sequence length; a repeated row is packed again; a null doc_id
stays null; no rows give an empty result.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 2048
OPEN_BINS = 4096
VOCABULARY = "word_bpe_49k.json"
#: Parts whose ids a Python worker keeps; beyond it the table starts afresh.
KEPT_PARTS = 500_000
#: Partitions (2**n of them) whose last bins are packed together.
BESIDE_BITS = 6
_TASK_SHIFT = 40
_MARK = "<|endoftext|>"
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[list(b'!"#$%&()*+,-./:;<=>?@[]^_`{|}~')] = _SIGN  # no apostrophe: 's is one token
_LATIN = np.zeros(256, bool)  # second bytes of the letters U+00C0 to U+00FF
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: The signs that a byte-level vocabulary writes for bytes that are no printable Latin-1.
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


def _cuts(data: np.ndarray) -> np.ndarray:
    """Positions that no token spans: between letters, digits and signs."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_LATIN[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    return np.flatnonzero((kind[:-1] != kind[1:]) & (kind[:-1] > 0) & (kind[1:] > 0)) + 1


class PartIds:
    """Token ids of texts, by way of a table of their parts' ids."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end, self.is_mark = (np.zeros(max(vocabulary.values()) + 1, bool) for _ in range(2))
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.is_mark[vocabulary[_MARK]] = True
        self.digits = np.array([vocabulary[f"{d}</w>"] for d in range(10)], "<u4")
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = np.empty(1 << 16, "<u4")
        self.first, self.size, self.used = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _group(self, texts: list[str], glue: str, ends_at: np.ndarray, drop: int) -> list[list[int]]:
        """Ids of many parts in one call, cut where ends_at marks an id; one by one if the cuts don't add up."""
        out = []
        for a in range(0, len(texts), 1000):
            group = texts[a : a + 1000]
            ids = self._plain(glue.join(group) + glue)
            ends = (np.flatnonzero(ends_at[ids]) + 1).tolist()
            if len(ends) != len(group):
                out += [self._plain(t) for t in group]
            else:
                out += [ids[i : j - drop] for i, j in zip([0, *ends], ends)]
        return out

    def _learn(self, parts: list[bytes]) -> None:
        plain, words, odd, ids = [], [], [], []
        for p in parts:
            if p.isalpha():
                plain.append(p)
                ids.append([t.id for t in self.model.tokenize(p.decode())])
            elif p.isdigit():
                plain.append(p)
                ids.append(self.digits[np.frombuffer(p, np.uint8) - 48].tolist())
            else:
                t = p.decode("utf-8", "replace")
                if not t.isalpha():
                    odd.append((p, t))
                elif max(t) <= "\xff":
                    # letters of Latin-1 are normal as they are; the model reads their bytes as signs
                    plain.append(p)
                    ids.append([t.id for t in self.model.tokenize(t.lower().encode().decode("latin-1").translate(_BYTE_SIGNS))])
                else:
                    words.append((p, t))
        # a part of letters only is one word, and its last token alone is a word end
        ids += self._group([t for _, t in words], " ", self.word_end, 0)
        ids += self._group([t for _, t in odd], _MARK, self.is_mark, 1)
        n, k = len(self.known), len(ids)
        self.known.update(zip([*plain, *(p for p, _ in words), *(p for p, _ in odd)], range(n, n + k)))
        size = np.fromiter(map(len, ids), np.int64, k)
        flat = np.fromiter((i for x in ids for i in x), "<u4", int(size.sum()))
        for name, used, more in (("pool", self.used, len(flat)), ("first", n, k), ("size", n, k)):
            old = getattr(self, name)
            if used + more > len(old):
                new = np.empty(max(2 * len(old), used + more), old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)
        self.pool[self.used : self.used + len(flat)] = flat
        self.first[n : n + k], self.size[n : n + k] = self.used + np.cumsum(size) - size, size
        self.used += len(flat)

    def of(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and where each text's begin, plus the end."""
        n, special = len(off) - 1, {}
        raw = data.tobytes()
        if b"<|" in raw:  # special tokens are read before anything else
            special = {k: np.array(self._plain(raw[off[k] : off[k + 1]].decode("utf-8", "replace")), "<u4") for k in range(n) if b"<|" in raw[off[k] : off[k + 1]]}
            data = data.copy()
            for k in special:
                data[off[k] : off[k + 1]] = 32
        cut = np.sort(np.concatenate([_cuts(data), off[1:-1]]))
        data = np.insert(C.LOWER[data], cut, 32)  # case is dropped: fewer distinct parts
        start = off + np.searchsorted(cut, off, side="right")
        parts = data.tobytes().split()
        own = set(parts)
        new = own.difference(self.known)
        if len(self.known) + len(new) > KEPT_PARTS:
            self._clear()
            new = own
        if new:
            self._learn(list(new))
        code = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        size = self.size[code]
        end = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(size, out=end[1:])
        ids = self.pool[np.repeat(self.first[code] - end[:-1], size) + np.arange(end[-1])]
        word = np.zeros(len(data) + 1, bool)
        word[1:] = ~C._SPACE[data]  # noqa: SLF001
        begun = np.zeros(len(data) + 1, np.int64)
        np.cumsum(word[1:] & ~word[:-1], out=begun[1:])
        bound = end[begun[np.minimum(start, len(data))]]
        if special:
            lots = [special.get(k, ids[bound[k] : bound[k + 1]]) for k in range(n)]
            ids, bound = np.concatenate(lots), np.cumsum([0, *map(len, lots)])
        return ids, bound


class BestFit:
    """Open bins by free space; place(need) gives (bin number, offset)."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.open_bins = length, open_bins
        self.by_free: dict[int, list[int]] = {}
        self.bits = self.n_open = self.n_bins = 0
        self.closed: list[int] = []  # bins that nothing more can be put in, until the caller takes them

    def _put(self, bin_: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(bin_)
            self.bits |= 1 << free
            self.n_open += 1
        else:
            self.closed.append(bin_)

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.n_open -= 1
        return bin_

    def place(self, need: int) -> tuple[int, int]:
        fits = self.bits >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))  # the fullest closes
            bin_, free = self.n_bins, self.length
            self.n_bins += 1
        self._put(bin_, free - need)
        return bin_, self.length - free


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32())] + [(k, pa.int64()) for k in ("start", "length", "ids_crc32", "sequence_id", "offset")])
_KEPT = _ARROW.append(pa.field("last", pa.bool_()))


def _rows(rows: list[tuple], last: bool) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(columns, _ARROW.types)), pa.array([last] * len(rows), pa.bool_())], schema=_KEPT)


def pack(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH, open_bins: int = OPEN_BINS, end_id: int = 0) -> DataFrame:
    """One row per piece of each document, with its sequence and its place there."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(VOCABULARY)

    def run(batches):
        kept = sys.__dict__.setdefault("_tessera_part_ids", {})  # lives as long as the worker
        if tokenizer_path not in kept:
            kept[tokenizer_path] = PartIds(tokenizer_path)
        ids_of, bins = kept[tokenizer_path], BestFit(length, open_bins)
        base = TaskContext.get().partitionId() << _TASK_SHIFT
        held: dict[int, list[tuple]] = {}  # rows of the bins that are open
        for batch in batches:
            docs_ = batch.column(0).to_pylist()
            for a, b, data, off in C.text_slices(batch.column(1)):
                ids, bound = ids_of.of(data, off)
                n = b - a
                tokens = np.full(len(ids) + n, end_id, "<u4")
                tokens[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bound))] = ids
                begin = bound + np.arange(n + 1)
                size = np.diff(begin)
                count = -(-size // length)
                doc = np.repeat(np.arange(n), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                at = piece * length
                cut = np.minimum(size[doc] - at, length)
                order = np.argsort(-cut, kind="stable")  # a look-ahead of one slice: long pieces first
                raw = memoryview(tokens.tobytes())
                out = []
                for k, p, s, m, x in zip(*(v[order].tolist() for v in (doc, piece, at, cut, begin[doc] + at))):
                    bin_, offset = bins.place(m)
                    held.setdefault(bin_, []).append((docs_[a + k], p, s, m, zlib.crc32(raw[4 * x : 4 * (x + m)]), base + bin_, offset))
                    for full in bins.closed:
                        out += held.pop(full)
                    bins.closed.clear()
                yield _rows(out, False)
        yield _rows([r for rows in held.values() for r in rows], True)

    def merge(t: pa.Table) -> pa.Table:
        """The pieces in last bins of partitions, packed again, the longest first."""
        size = t["length"].to_numpy()
        # in an order of their own, so that places don't depend on arrival
        order = np.lexsort((t["offset"].to_numpy(), t["sequence_id"].to_numpy(), -size))
        bins, at = BestFit(length, open_bins), np.empty((2, len(order)), np.int64)
        for k, m in zip(order.tolist(), size[order].tolist()):
            at[:, k] = bins.place(m)
        # numbers that no partition gives: these bins are packed anew
        base = (int(t["sequence_id"][0].as_py()) >> (_TASK_SHIFT + BESIDE_BITS) << (_TASK_SHIFT + BESIDE_BITS)) + (1 << (_TASK_SHIFT - 1))
        return pa.Table.from_arrays([*t.select(_ARROW.names[:5]).columns, pa.array(base + at[0]), pa.array(at[1])], schema=_ARROW)

    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + ", last boolean")
    packed = C.Scratch(docs.sparkSession).keep(packed)
    columns = _ARROW.names
    last = packed.where("last").select(*columns).groupBy(F.shiftright("sequence_id", _TASK_SHIFT + BESIDE_BITS).alias("beside")).applyInArrow(merge, SCHEMA)
    return packed.where("NOT last").select(*columns).unionByName(last)


def op4(spark, sf_dir):
    return pack(C.table(spark, sf_dir, "documents"))
