"""SentencePiece encoding and decoding with merge-type vocabularies, by a score-ordered agenda.

A text becomes symbols of one character each, spaces written as the vocabulary
writes them.  An agenda holds every adjacent pair of symbols whose joined text is
a piece; the pair of the highest score, the leftmost among equals, is joined
first, its new neighbours enter the agenda, and entries whose symbols have
changed meanwhile are passed over.  What is no piece at the end is written as
bytes.  Decoding turns ids back into text, runs of byte ids as UTF-8.

A text is cut where no piece of the vocabulary reaches across: before a run of
spaces, and between characters that no chain of pieces joins (here letters, signs,
single digits).  Both follow from the vocabulary when it is loaded; one without
such cuts has each text as one segment.  No merge spans a cut, so the ids of
segments are kept in a bounded table.  Segments that an Arrow batch has and the
table lacks go through one agenda together, an array with an entry a pair, from
which every round takes each segment's best; long segments have a heap of their
own, from which entries are passed over whose symbols have changed meanwhile.
All of them then go through the sentencepiece library, as does one whole text of
every Arrow batch: any difference ends the query with an error.

Texts stay where they are; nothing is shuffled.

Cases: a null or empty text has no ids, and decodes to the empty text; a space
sign in a text is read as a space, as the library does; a repeated row is encoded
again; a null doc_id stays null; no rows give an empty result.  Columns beyond
the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import sys
import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "piece_bpe_32k.model"
#: Segments whose ids a Python worker keeps; beyond it only those in use stay.
KEPT_SEGMENTS = 400_000
#: Longer segments are encoded each time.
KEPT_CHARACTERS = 64
SPACE = "▁"
_BPE, _NORMAL, _UNKNOWN, _CONTROL, _BYTE = 2, 1, 2, 3, 6
#: Longer segments have a heap each: rounds of the common agenda are merges of its longest segment.
HEAP_SYMBOLS = 40
_NONE = np.iinfo(np.int64).max


class PieceModel:
    """A merge-type vocabulary: ids of texts and texts of ids."""

    def __init__(self, proto: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(proto)
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != _BPE or not model.trainer_spec.byte_fallback or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("a merge-type vocabulary with bytes for unknown characters is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only vocabularies that leave texts as they are can be used")
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == _NORMAL and len(p.piece) > 1}
        self.byte_ids = [0] * 256
        self.texts: list[bytes | int] = []  # what an id decodes to; a number for one byte
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.texts.append(int(p.piece[1:-1], 16))
            elif p.type == _CONTROL:
                self.texts.append(b"")
            elif p.type == _UNKNOWN:
                self.texts.append(model.trainer_spec.unk_surface.encode())
            else:
                self.texts.append(p.piece.replace(SPACE, " ").encode())
        self.leads = [p.type == _NORMAL and p.piece.startswith(SPACE) for p in model.pieces]
        self.decimal = [str(i).encode() for i in range(len(self.texts))]
        self._cuts()
        self._tables()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.known: dict[str, bytes] = {}  # ids of segments as decimals joined by commas
        self.odd: dict[str, str] = {}  # what segments decode to that decode to something else

    def agenda(self, text: str) -> list[int]:
        """Ids of a text whose spaces are written as space signs already."""
        cost, symbols = self.cost, list(text)
        n = len(symbols)
        heap = [(cost[ab], i, ab) for i, ab in enumerate(map(str.__add__, symbols, symbols[1:])) if ab in cost]
        if heap:
            heapify(heap)
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            while heap:
                _, i, ab = heappop(heap)
                a, j = symbols[i], after[i]
                if not a or j >= n or a + symbols[j] != ab:
                    continue  # one of the two has changed
                symbols[i], symbols[j] = ab, ""
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (new := ab + symbols[k]) in cost:
                        heappush(heap, (cost[new], i, new))
                h = before[i]
                if h >= 0 and (new := symbols[h] + ab) in cost:
                    heappush(heap, (cost[new], h, new))
        return [i for s in symbols if s for i in self._own(s)]

    def _own(self, symbol: str) -> list[int]:
        id_ = self.ids.get(symbol)
        return [self.byte_ids[b] for b in symbol.encode()] if id_ is None else [id_]

    def _tables(self) -> None:
        """Numbers for pieces and characters, and for each pair that joins: key, order of its score, joined number."""
        symbols = list(dict.fromkeys([*self.ids, *(c for p in self.ids for c in p)]))
        number = {x: i for i, x in enumerate(symbols)}
        self.of_char = np.full(sys.maxunicode + 1, -1, np.int64)
        for x, i in number.items():
            if len(x) == 1:
                self.of_char[ord(x)] = i
        self.symbols, self.id_of = symbols, np.array([self.ids.get(x, -1) for x in symbols], np.int64)
        place = {c: k for k, c in enumerate(sorted(set(self.cost.values())))}
        rows = [
            (number[p[:k]] << 32 | number[p[k:]], place[c], number[p])
            for p, c in self.cost.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        ]
        self.pair_key, self.pair_order, self.pair_joined = np.array(sorted(rows), np.int64).reshape(-1, 3).T.copy()

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the score and joined number of pairs; _NONE where a pair doesn't join."""
        if not len(self.pair_key):
            return np.full(len(a), _NONE), a
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_order[at], _NONE), self.pair_joined[at]

    def agendas(self, texts: list[str]) -> list[list[int]]:
        """agenda() of many short texts at once: every round joins the best pair of each text."""
        char = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        sym, text = self.of_char[char], np.repeat(np.arange(len(texts)), size)
        sym = np.where(sym < 0, -1 - char, sym)
        order, joined = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(text[:-1] == text[1:])
        order[inner], joined[inner] = self._pairs(sym[inner], sym[inner + 1])
        done = []
        while len(sym):
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            best = np.minimum.reduceat(order, first)
            open_ = np.repeat(best < _NONE, np.diff(np.r_[first, len(sym)]))
            if not open_.all():
                done.append((text[~open_], sym[~open_]))
                sym, text, order, joined = sym[open_], text[open_], order[open_], joined[open_]
                first, best = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else first[:0], best[best < _NONE]
            if not len(sym):
                break
            # the leftmost of each text's best pairs
            at = np.flatnonzero(order == np.repeat(best, np.diff(np.r_[first, len(sym)])))
            at = at[np.r_[True, text[at[1:]] != text[at[:-1]]]]
            sym[at] = joined[at]
            order[at] = order[at + 1]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))  # one symbol has gone before each
            sym, text, order, joined = sym[stay], text[stay], order[stay], joined[stay]
            left = at[(at > 0) & (text[at - 1] == text[at])] - 1
            right = at[at + 1 < len(sym)]
            right = right[text[right + 1] == text[right]]
            new = np.concatenate([left, right])
            order[at] = _NONE
            order[new], joined[new] = self._pairs(sym[new], sym[new + 1])
        text, sym = (np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64),) * 2
        sym = sym[np.argsort(text, kind="stable")]
        count = [0, *np.cumsum(np.bincount(text, minlength=len(texts))).tolist()]
        ids = np.where(sym < 0, -1, self.id_of[sym]).tolist()
        out = [ids[a:b] for a, b in zip(count, count[1:])]
        for k in np.unique(np.repeat(np.arange(len(texts)), np.diff(count))[np.array(ids, np.int64) < 0]).tolist():
            chars = (chr(-1 - x) if x < 0 else self.symbols[x] for x in sym[count[k] : count[k + 1]].tolist())
            out[k] = [i for c in chars for i in self._own(c)]
        return out

    def _cuts(self) -> None:
        """The pattern of segments, and a character that joins no other one."""
        kin: dict[str, str] = {}

        def find(c):
            while kin.setdefault(c, c) != c:
                c = kin[c]
            return c

        alone = {chr(i) for i in range(128)} - {" "}
        for p in self.ids:
            word = p.lstrip(SPACE)
            for a, b in zip(word, word[1:]):
                kin[find(a)] = find(b)
                alone -= {a, b}
        groups: dict[str, list[str]] = {}
        for c in kin:
            groups.setdefault(find(c), []).append(c)
        some = lambda chars: "".join(map(re.escape, sorted(chars)))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or not alone or not self.prefix:
            self.segment, self.lead = re.compile(r"(?s).+"), ""
            return
        # the largest group takes what the vocabulary doesn't have
        signs = sorted(groups.values(), key=len)[:-1]
        rest = "".join(some(g) for g in [alone, *signs])
        self.segment = re.compile("|".join([f" *[^ {rest}]+", *(f" *[{some(g)}]+" for g in signs), f" *[{some(alone)}]", " +"]))
        self.lead = min(alone & set(self.ids), default="")

    def _joined(self, ids: list[int]) -> bytes:
        """Decoded bytes of ids, the space before the first word included."""
        parts = list(map(self.texts.__getitem__, ids))
        try:
            return b"".join(parts)
        except TypeError:  # bytes among them
            runs = itertools.groupby(parts, lambda x: isinstance(x, int))
            return b"".join(whole_characters(bytes(run)) if single else b"".join(run) for single, run in runs)

    def encode(self, text: str) -> list[int]:
        return self.agenda((self.prefix + text).replace(" ", SPACE)) if text else []

    def decode(self, ids: list[int]) -> str:
        out = self._joined(ids)
        return (out[1:] if self.prefix and ids and self.leads[ids[0]] else out).decode()

    def _learn(self, segments: list[str]) -> None:
        """Ids of segments, compared with the library's, and what they decode to."""
        shown = [t.replace(" ", SPACE) for t in segments]
        ids: list = [self.agenda(t) if len(t) > HEAP_SYMBOLS else None for t in shown]
        short = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(short, self.agendas([shown[k] for k in short])):
            ids[k] = x
        # after a character that joins nothing a segment stands as in a text
        lead, cut = self.lead, len(self.library.encode(self.lead))
        if lead:
            for t, own, other in zip(segments, ids, self.library.encode([lead + t for t in segments], num_threads=1)):
                if own != other[cut:]:
                    raise RuntimeError(f"agenda and library differ on {t[:80]!r}")
        for t, x in zip(segments, ids):
            self.known[t] = b",".join(map(self.decimal.__getitem__, x))
            if (back := self._joined(x).decode()) != t:
                self.odd[t] = back

    def segments(self, text: str) -> list[str]:
        """Parts that no merge spans, after the space that the library puts before a text."""
        return self.segment.findall(self.prefix + text.replace(SPACE, " ")) if text else []

    def of(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as decimals joined by commas, and what they decode to."""
        split = [self.segments(t) for t in texts]
        own = set().union(*split)
        new = [s for s in own if s not in self.known]
        if len(self.known) + len(new) > KEPT_SEGMENTS:
            self.known = {s: self.known[s] for s in own if s in self.known}
            self.odd = {s: self.odd[s] for s in own if s in self.odd}
        if new:
            self._learn(new)
        out, cut, odd = [], len(self.prefix), self.odd
        for parts in split:
            back = "".join([odd.get(p, p) for p in parts] if odd else parts)
            out.append((b",".join(map(self.known.__getitem__, parts)), back[cut:]))
        for s in new:
            if len(s) > KEPT_CHARACTERS:
                del self.known[s]
                self.odd.pop(s, None)
        return out

    def check(self, text: str, ids: bytes) -> None:
        if ids != b",".join(map(self.decimal.__getitem__, self.library.encode(text))):
            raise RuntimeError(f"segments and library differ on {text[:80]!r}")


def whole_characters(raw: bytes) -> bytes:
    """UTF-8 as it is; each byte that begins no character becomes a replacement sign."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode().encode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�".encode())
                at += 1
        return b"".join(out)


def load_model(proto: bytes) -> PieceModel:
    """The model of a worker: made once, with its table of segments."""
    kept = sys.__dict__.setdefault("_tessera_piece_models", {})
    key = zlib.crc32(proto), len(proto)
    if key not in kept:
        kept[key] = PieceModel(proto)
    return kept[key]


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


def _encoded(model: PieceModel, batch: pa.RecordBatch):
    """(ids column, ids and decoded texts) of a slice of the batch after the other."""
    for n, (a, b, data, off) in enumerate(C.text_slices(batch.column(1))):
        raw = data.tobytes()
        texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(off.tolist(), off[1:].tolist())]
        got = model.of(texts)
        if not n:
            model.check(texts[0], got[0][0])
        yield batch.column(0).slice(a, b - a), got


def encode(docs: DataFrame, model_path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids for every row: the token ids of the whole text."""
    proto = model_bytes(model_path)

    def run(batches):
        model = load_model(proto)
        for batch in batches:
            for docs_, got in _encoded(model, batch):
                ids = pa.array([[int(i) for i in g[0].split(b",")] if g[0] else [] for g in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([docs_, ids], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text for every row: what the ids decode to; null ids are none."""
    proto = model_bytes(model_path)

    def run(batches):
        model = load_model(proto)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both directions in one pass, ids never leave the worker."""
    proto = model_bytes(model_path)

    def run(batches):
        model, sha = load_model(proto), lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for docs_, got in _encoded(model, batch):
                size = pa.array([g[0].count(b",") + 1 if g[0] else 0 for g in got], pa.int64())
                columns = [docs_, size, pa.array([sha(g[0]) for g in got]), pa.array([sha(g[1].encode()) for g in got])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12(spark, sf_dir):
    return digests(C.table(spark, sf_dir, "documents"))
