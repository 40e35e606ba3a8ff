"""Personal data: checked patterns, and a skip-chain conditional random field.

The patterns find base spans (email, ip, card, phone) in whole texts.  The field
labels the tokens that hold a digit, ``@`` or ``+``, and those without that have the
letters of the local part of an address in the same text (any other token can't be
personal data here and is outside).  Potentials: hashed features of a token and
its neighbours; a chain edge between tokens that follow each other; a skip edge
from a token to the one before it with the same letters and digits, the same
last seven digits or the same local part of an address.  Tokens in base spans
are observed; loopy sum-product messages carry their labels along the edges, so a
mention that no pattern fits (a number without its country code, say) gets the label
of its full form, however far away, and one that nothing else in the document
supports gets none.  Tokens labelled with confidence and outside all base spans
become further spans.  Skip edges join neighbouring occurrences only, so
the graph grows with the text, not with the square of a token's count.

Weights are learned by pseudo-likelihood from a bounded sample, whose labels are
the base spans.  Patterns explain those labels by the token alone, so the sample
is given, for each token of a span, mentions of it that no pattern fits, joined
to it and labelled alike, and two strangers of the same form, joined to each other
and outside: what tells them apart is the skip edge.  A mention that is one plain word
(the ``info`` of an address) is as likely common language: it is joined to the span
and outside, so names need a separator or a digit to be told by their address.
Tokens outside that share their letters and digits with a span are left out.

Cases: a null or empty text has no spans; a repeated row is searched again; a
text of one very long word is searched in linear time; no rows give an empty
result; without any base span in the sample the field adds nothing.  Columns
beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
#: At most this many documents are learned from: those whose hashed id is lowest.
SAMPLE_ROWS = 400
BITS, STEPS, RATE, DECAY = 12, 300, 0.6, 0.01
ROUNDS = 10
CONFIDENT = 0.75
#: Weight of an observed label.
OBSERVED = 12.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEPARATORS = {32: None, 45: None}


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; a local part starts where its run of signs does."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            # the run before the next sign can't reach over this one
            free = at + 1
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _byte_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in code points."""
    ips = [m.span() for m in _IP.finditer(text) if all(map(_byte_part, m.group().split(".")))]
    cards = []
    for m in _CARD.finditer(text):
        digits = m.group().translate(_SEPARATORS)
        if 16 <= len(digits) <= 19 and luhn(digits):
            cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return [emails(text), ips, cards, phones]


def _joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans) for a, b in sorted(found))


_TRIM = "\"'`.,;:!?*#&%$()[]{}<>|"


_DIGITS, _PLAIN = re.compile("[^0-9]+"), re.compile(r"[\W_]+")
#: A word of letters alone.
_WORD = re.compile(r"[^\W\d_]+")
#: What keys leave out, but for the signs between words.
_DIGIT = re.compile("[0-9]")
_WITHIN = re.compile(r"[^\w\x20\x09-\x0D]+|_+")


def features(bare: str, before: str, after: str) -> list[int]:
    digits = _DIGITS.sub("", bare)
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "0", re.sub("[^\x00-\x7f]|[a-z]", "a", re.sub("[A-Z]", "A", bare))))
    names = (
        "bias", f"shape {shape}", f"length {min(len(bare), 24)}", f"digits {min(len(digits), 20)}", f"at {'@' in bare}", f"dots {min(bare.count('.'), 4)}",
        f"plus {bare[0] == '+'}", f"luhn {13 <= len(digits) <= 19 and luhn(digits)}", f"before {before.lower()}", f"after {after.lower()}",
    )
    return [zlib.crc32(n.encode("utf-8", "replace")) & ((1 << BITS) - 1) for n in names]


def keys(bare: str) -> list[str]:
    """What another token must have to be joined to this one; short ones join nothing."""
    low = bare.lower()
    local, at, _ = low.partition("@")
    out = [_PLAIN.sub("", low), _PLAIN.sub("", local) if at else ""]
    digits = _DIGITS.sub("", bare)
    if len(digits) >= 7 and not any(c.isalpha() for c in bare):
        out.append(digits[-7:])
    return [k for k in dict.fromkeys(out) if len(k) >= 4]


def bare_form(token: str) -> str:
    """A token as a mention in passing has it: an address without its domain, a number's digits alone."""
    local, at, _ = token.partition("@")
    return local if at and local else _DIGITS.sub("", token) or token


class Graph:
    """Candidate tokens of many texts: features, edges, and where each stands."""

    def __init__(self):
        self.features, self.text, self.span = [], [], []
        self.word: list[int] = []
        self.chain, self.skip, self.bare, self.near = [], [], [], []
        self._last: dict[str, int] = {}

    def new_text(self) -> None:
        self._last = {}

    def add(self, text_no: int, word_no: int, token: str, start: int, before: str, after: str) -> None:
        bare = token.strip(_TRIM)
        if not bare:
            return
        lead = token.index(bare)
        i = len(self.features)
        self.features.append(features(bare, before, after))
        self.bare.append(bare)
        self.near.append((before, after))
        self.text.append(text_no)
        self.span.append((start + lead, start + lead + len(bare)))
        self.word.append(word_no)
        if i and self.text[i - 1] == text_no and self.word[i - 1] == word_no - 1:
            self.chain.append((i - 1, i))
        own = keys(bare)
        self.skip += [(j, i) for j in dict.fromkeys(self._last[k] for k in own if k in self._last)]
        self._last.update(dict.fromkeys(own, i))

    def to_learn(self, y: np.ndarray) -> tuple[list[list[int]], np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
        """Features, labels, chain and skip edges to learn from, given the patterns' labels.

        A token outside all spans that a skip edge joins to one inside is neither
        an example nor a neighbour: the patterns can't tell.  Every labelled token
        has a bare mention and two strangers like it added, in the surroundings of other tokens.
        """
        y = y.copy()
        doubt = [i if y[j] else j for i, j in self.skip if (y[i] > 0) != (y[j] > 0)]
        y[doubt] = -1
        x, labels = list(self.features), y.tolist()
        chain, skip = ([(i, j) for i, j in edges if y[i] >= 0 and y[j] >= 0] for edges in (self.chain, self.skip))
        for i in np.flatnonzero(y > 0).tolist():
            for form in dict.fromkeys((self.bare[i], bare_form(self.bare[i]))):
                if keys(form) and not any(base_spans(form)):
                    n = len(x)
                    x += [features(form, *self.near[(i + k) % len(self.near)]) for k in (1, 1, 2)]
                    labels += [0 if _WORD.fullmatch(form) else labels[i], 0, 0]
                    skip += [(i, n), (n + 1, n + 2)]
        return x, np.array(labels, np.int64), chain, skip


_FLAG = np.zeros(256, bool)
_FLAG[list(b"0123456789@+")] = True


def _bare_locals(tokens: list[str]) -> set[str]:
    """Keys of the local parts of addresses among tokens that hold no digit: mentions of them carry no flag."""
    found = set()
    for token in tokens:
        local, at, _ = token.strip(_TRIM).lower().partition("@")
        key = _PLAIN.sub("", local) if at else ""
        if len(key) >= 4 and not _DIGIT.search(local):
            found.add(key)
    return found


def _mentions(text: str, words: list[str], wanted: set[str]) -> list[int]:
    """Which words have the letters of a wanted key, their separators apart."""
    if wanted.isdisjoint(_WITHIN.sub("", text.lower()).split()):
        return []
    return [i for i, w in enumerate(words) if _PLAIN.sub("", w.lower()) in wanted]


def candidates(data: np.ndarray, off: np.ndarray) -> tuple[list[str | None], Graph]:
    """Texts that hold any candidate (None for others), and the graph over all of them."""
    n = len(off) - 1
    texts: list[str | None] = [None] * n
    graph = Graph()
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_FLAG[data], out=seen[1:])
    if not seen[-1]:
        return texts, graph
    start, end, doc = C.word_spans(data, off)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    raw = data.tobytes()
    word = lambda k, d: raw[start[k] : end[k]].decode() if 0 <= k < len(start) and doc[k] == d else ""
    flagged = np.flatnonzero(seen[end] > seen[start])
    cuts = [0, *(np.flatnonzero(np.diff(doc[flagged])) + 1).tolist(), len(flagged)] if len(flagged) else [0]
    for s, e in zip(cuts, cuts[1:]):
        d, picked = int(doc[flagged[s]]), flagged[s:e].tolist()
        texts[d] = raw[off[d] : off[d + 1]].decode()
        graph.new_text()
        wanted = _bare_locals([word(k, d) for k in picked])
        if wanted:
            first, after = np.searchsorted(doc, [d, d + 1]).tolist()
            more = _mentions(texts[d], [word(k, d) for k in range(first, after)], wanted)
            picked = sorted({*picked, *(first + i for i in more)})
        for k in picked:
            graph.add(d, k, word(k, d), int(points[start[k]] - points[off[d]]), word(k - 1, d), word(k + 1, d))
    return texts, graph


def silver(graph: Graph, spans: dict[int, list[list[tuple[int, int]]]]) -> np.ndarray:
    """Label of each token: 0 outside, else 1 + the kind of a base span that it touches."""
    y = np.zeros(len(graph.features), np.int64)
    for kind in range(len(KINDS)):
        for text_no, found in spans.items():
            found[kind].sort()
        starts = {t: [a for a, _ in s[kind]] for t, s in spans.items()}
        for i, (t, (a, b)) in enumerate(zip(graph.text, graph.span)):
            if t not in spans or y[i]:
                continue
            j = int(np.searchsorted(starts[t], b)) - 1
            if j >= 0 and spans[t][kind][j][1] > a:
                y[i] = kind + 1
    return y


class Field:
    """Weights of tokens (features x labels) and of chain and skip edges (labels x labels)."""

    LABELS = 1 + len(KINDS)

    def __init__(self, blob: bytes | None = None):
        k = self.LABELS
        self.flat = np.zeros(((1 << BITS) + 2 * k) * k) if blob is None else np.frombuffer(blob, "<f8").copy()
        self.token, self.chain, self.skip = self._views(self.flat)

    def _views(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = self.LABELS
        return flat[: -2 * k * k].reshape(-1, k), flat[-2 * k * k : -k * k].reshape(k, k), flat[-k * k :].reshape(k, k)

    def learn(self, graphs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Ascend the pseudo-likelihood, each token given its neighbours' labels, all documents at once; labels below 0 are not known."""
        if not graphs:
            return
        at = np.cumsum([0, *(len(y) for _, y, _, _ in graphs)])
        x, y = (np.concatenate([g[i] for g in graphs]) for i in (0, 1))
        chain, skip = (np.concatenate([g[i] + a for g, a in zip(graphs, at.tolist())]) for i in (2, 3))
        k, known = self.LABELS, y >= 0
        want, squares = np.eye(k)[np.maximum(y, 0)], np.full_like(self.flat, 1e-8)
        step = np.empty_like(self.flat)
        token, *joint = self._views(step)
        for _ in range(STEPS):
            u = self.token[x].sum(1)
            for edges, w in ((chain, self.chain), (skip, self.skip)):
                np.add.at(u, edges[:, 1], w[y[edges[:, 0]]])
                np.add.at(u, edges[:, 0], w.T[y[edges[:, 1]]])
            p = np.exp(u - u.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = np.where(known[:, None], want - p, 0)
            for label in range(k):
                token[:, label] = np.bincount(x.ravel(), np.repeat(g[:, label], x.shape[1]), len(token))
            for edges, w in ((chain, joint[0]), (skip, joint[1])):
                w[:] = 0
                np.add.at(w, y[edges[:, 0]], g[edges[:, 1]])
                np.add.at(w.T, y[edges[:, 1]], g[edges[:, 0]])
            step -= DECAY * self.flat
            squares += step * step
            self.flat += RATE * step / np.sqrt(squares)

    def marginals(self, x: np.ndarray, chain: np.ndarray, skip: np.ndarray, observed: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product in logarithms, damped, a fixed number of rounds; observed: labels above 0 are known."""
        k, unary = self.LABELS, self.token[x].sum(1)
        if observed is not None:
            known = np.flatnonzero(observed)
            unary[known, observed[known]] += OBSERVED
        edges = np.concatenate([chain, skip]).astype(np.int64)
        belief = unary
        if len(edges):
            pair = np.concatenate([np.broadcast_to(self.chain, (len(chain), k, k)), np.broadcast_to(self.skip, (len(skip), k, k))])
            # messages go both ways: e to its second end, then e to its first
            src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            m = np.zeros((len(src), k))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, dst, m)
                inner = (belief[src] - m[back])[:, :, None] + pair
                top = inner.max(1, keepdims=True)
                new = np.log(np.exp(inner - top).sum(1)) + top[:, 0]
                new -= new.max(1, keepdims=True)
                m = 0.5 * m + 0.5 * new
            belief = unary.copy()
            np.add.at(belief, dst, m)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _edges(pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.array(pairs, np.int64).reshape(-1, 2)


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> bytes:
    """Weights of the field, of a fixed size, from at most `rows` documents."""
    flagged = docs.where(F.col("text").rlike("[0-9@+]")).select("doc_id").where("doc_id IS NOT NULL")
    sample = flagged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    picked = docs.join(F.broadcast(sample), "doc_id", "left_semi")

    def extract(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for a, b, data, off in C.text_slices(batch.column(1)):
                for d in range(b - a):
                    texts, g = candidates(data[off[d] : off[d + 1]], np.array([0, off[d + 1] - off[d]]))
                    if texts[0] is None or not g.features:
                        continue
                    x, y, chain, skip = g.to_learn(silver(g, {0: base_spans(texts[0])}))
                    out.append((ids[a + d], *(np.asarray(v, "<i4").tobytes() for v in (x, y, _edges(chain), _edges(skip)))))
            yield pa.RecordBatch.from_pydict({k: [r[i] for r in out] for i, k in enumerate(("doc_id", "x", "y", "c", "s"))}, pa.schema([("doc_id", pa.int64())] + [(k, pa.binary()) for k in "xycs"]))

    def fit(t: pa.Table) -> pa.Table:
        graphs, field = [], Field()
        for _, x, y, c, s in sorted(zip(*(t[k].to_pylist() for k in ("doc_id", "x", "y", "c", "s")))):
            x, y, c, s = (np.frombuffer(v, "<i4").astype(np.int64) for v in (x, y, c, s))
            graphs.append((x.reshape(len(y), -1), y, c.reshape(-1, 2), s.reshape(-1, 2)))
        field.learn(graphs)
        return pa.table({"w": pa.array([field.flat.astype("<f8").tobytes()], pa.binary())})

    # one task learns: the sample is bounded and the updates are sequential
    got = picked.mapInArrow(extract, "doc_id long, x binary, y binary, c binary, s binary").groupBy(F.lit(0).alias("one")).applyInArrow(fit, "w binary").collect()
    return got[0].w if got else Field().flat.tobytes()


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
_ARROW = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def find(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts of base spans, their digest, and all spans, for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, rows))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        field = Field(model.value)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for a, b, data, off in C.text_slices(batch.column(1)):
                texts, g = candidates(data, off)
                spans = {d: base_spans(t) for d, t in enumerate(texts) if t is not None}
                base = {d: ([len(s) for s in found], _joined(found)) for d, found in spans.items()}
                added = dict.fromkeys(spans, 0)
                if g.features:
                    known = silver(g, spans)
                    p = field.marginals(np.array(g.features), _edges(g.chain), _edges(g.skip), known)
                    label, sure, free = p.argmax(1), p.max(1) >= CONFIDENT, known == 0
                    last = None
                    for i in np.flatnonzero(sure & free & (label > 0)).tolist():
                        t, kind, span = g.text[i], int(label[i]) - 1, g.span[i]
                        if last == (i - 1, t, kind) and g.word[i] == g.word[i - 1] + 1:
                            spans[t][kind][-1] = (spans[t][kind][-1][0], span[1])
                        else:
                            spans[t][kind].append(span)
                            added[t] += 1
                        last = (i, t, kind)
                for d in range(b - a):
                    if d in spans:
                        out.append((ids[a + d], *base[d][0], hashlib.sha256(base[d][1].encode()).hexdigest(), _joined(spans[d]), added[d]))
                    else:
                        out.append((ids[a + d], 0, 0, 0, 0, nothing, "", 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

    return docs.mapInArrow(run, SCHEMA)


def op3(spark, sf_dir):
    return find(C.table(spark, sf_dir, "documents"))
