"""Toxic spans by a linear-chain conditional random field.

A token is a run of letters, digits and bytes above ASCII, A-Z in lower case. Its features
are its hashed word and its first 4, 5 and 6 bytes; the labels are ``other`` and ``toxic``
with learned transitions. Documents carry one label each, so the labelled tokens are made
first: in toxic documents, a token is toxic if one of its features occurs in toxic documents
far more than chance allows (a likelihood ratio over document counts). The field is fitted to
those sequences by gradient ascent; forward-backward gives each token's marginal. A document's
score is a logistic curve over its highest marginal and the sum of the notable ones, drawn on
sample documents left out of a first fit; offending spans are the maximal runs of tokens whose
marginal passes the threshold, as offsets in characters.

The fit sees at most ``SAMPLE_ROWS`` labelled documents in one task; scoring is one pass
without shuffle over whole texts. Forward and backward run as a scan of linear fractional
maps over all tokens of many documents at once. Texts without tokens, null or empty, get the
lowest score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.sampling import held_out, labelled_sample, logistic
from ledgerflow.llm.text import MIXED_LOWER, runs, span_hashes, words

BITS = 20
PREFIXES = (4, 5, 6)
SAMPLE_ROWS = 4_000
STEPS = 30
THRESHOLD = 0.5
EVIDENCE = (12.0, 6.0, 3.0)  # log-likelihood ratios asked of a toxic feature; lower ones only if nothing passes

GAPS = np.ones(256, bool)
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    features: np.ndarray  # (1 + len(PREFIXES), tokens); column 0 of the weights stands for none


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    start, end, first = words(data, offsets, GAPS)
    top = np.uint64(64 - BITS)
    kinds = [span_hashes(data, start, end, MIXED_LOWER)]
    for n in PREFIXES:
        part = span_hashes(data, start, np.minimum(start + n, end), MIXED_LOWER) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)
        kinds.append(np.where(end - start > n, part, np.uint64(0)))
    return Tokens(start, end, first, np.stack([(k >> top).astype(np.int64) for k in kinds]))


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, width: int = 64) -> np.ndarray:
    """x[t] = (a[t] + b[t] x[t-1]) / (c[t] + d[t] x[t-1]) with x[-1] = 0, for all t.

    The maps of each stretch of ``width`` steps are composed, the scan of the composed maps
    gives where each stretch starts, and all stretches then advance side by side.
    """
    n = len(a)
    if n <= width:
        out, x = np.empty(n), 0.0
        for t in range(n):
            x = out[t] = (a[t] + b[t] * x) / (c[t] + d[t] * x)
        return out
    rows = -(-n // width)
    pad = rows * width - n
    maps = [np.concatenate([m, np.full(pad, fill)]).reshape(rows, width).T.copy() for m, fill in ((a, 0.0), (b, 1.0), (c, 1.0), (d, 0.0))]
    p, q, r, s = (m[0].copy() for m in maps)
    for t in range(1, width):
        a1, b1, c1, d1 = (m[t] for m in maps)
        p, q, r, s = a1 * r + b1 * p, a1 * s + b1 * q, c1 * r + d1 * p, c1 * s + d1 * q
        size = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / size, q / size, r / size, s / size
    x = np.concatenate([[0.0], scan(p, q, r, s, width)[:-1]])
    out = np.empty((width, rows))
    for t in range(width):
        x = out[t] = (maps[0][t] + maps[1][t] * x) / (maps[2][t] + maps[3][t] * x)
    return out.T.reshape(-1)[:n]


@dataclass
class Field:
    weights: np.ndarray  # of "toxic" against "other", by feature
    moves: np.ndarray  # log potentials of other-other, other-toxic, toxic-other, toxic-toxic, start toxic
    curve: np.ndarray  # of document scores: highest marginal's log-odds, log of the notable sum, level

    def potentials(self, t: Tokens) -> np.ndarray:
        return np.exp(np.clip(self.weights[t.features].sum(0), -30, 30))

    def forward_backward(self, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Odds of toxic against other from the left (with the token) and from the right."""
        oo, ot, to, tt, begin = np.exp(self.moves)
        heads = first[:-1][first[:-1] < first[1:]]
        a, b, c, d = ot * e, tt * e, np.full(len(e), oo), np.full(len(e), to)
        a[heads], b[heads], c[heads], d[heads] = begin * e[heads], 0.0, 1.0, 0.0
        left = scan(a, b, c, d)
        # From the right the state is the odds behind a token; a row's last token has odds 1.
        after = np.ones(len(e))
        after[:-1] = e[1:]
        tails = first[1:][first[:-1] < first[1:]] - 1
        a, b, c, d = np.full(len(e), to), tt * after, np.full(len(e), oo), ot * after
        a[tails], b[tails], c[tails], d[tails] = 1.0, 0.0, 1.0, 0.0
        right = scan(a[::-1], b[::-1], c[::-1], d[::-1])[::-1]
        return left, right

    def marginals(self, t: Tokens) -> np.ndarray:
        if not len(t.start):
            return np.zeros(0)
        left, right = self.forward_backward(self.potentials(t), t.first)
        odds = left * right
        return odds / (1 + odds)


    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Document scores from the marginals of their tokens."""
        return 1 / (1 + np.exp(-np.clip(self.curve @ np.vstack([document_signs(p, first), np.ones(len(first) - 1)]), -30, 30)))


def document_signs(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: log-odds of its highest marginal, and log of one plus the sum of those over a tenth."""
    most = np.clip(row_max(p, first), 1e-5, 1 - 1e-5)
    total = np.concatenate([[0.0], np.cumsum(np.where(p > 0.1, p, 0.0))])
    return np.stack([np.log(most / (1 - most)), np.log1p(np.maximum(total[first[1:]] - total[first[:-1]], 0))])


def row_max(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1)
    some = first[:-1] < first[1:]
    if some.any():
        out[some] = np.maximum.reduceat(values, first[:-1][some])
    return out


def toxic_tokens(t: Tokens, label: np.ndarray) -> np.ndarray:
    """Which tokens of the sample count as toxic, from the documents' labels."""
    rows = np.repeat(np.arange(len(label)), np.diff(t.first))
    counts = np.zeros((2, 1 << BITS))
    for k in t.features:
        seen = np.unique(rows << BITS | k)
        np.add.at(counts, (label[seen >> BITS], seen & (1 << BITS) - 1), 1)
    share = label.mean()
    both = np.maximum(counts.sum(0), 1)
    inside = counts[1] / both
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nan_to_num(counts[1] * np.log(inside / share)) + np.nan_to_num(counts[0] * np.log((1 - inside) / (1 - share)))
    sure = (inside >= 0.9) & (inside > share)
    sure[0] = False
    for least in EVIDENCE:
        if (strong := sure & (ratio >= least)).any():
            break
    return strong[t.features].any(0) & (label[rows] == 1)


def fit_field(t: Tokens, label: np.ndarray, steps: int = STEPS, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Gradient ascent with per-parameter step sizes on the sequences' likelihood."""
    field = Field(np.zeros(1 << BITS), np.array([0.0, -2.0, 0.0, 0.0, -2.0]), np.array([0.0, 0.0, -5.0]))
    if not len(t.start) or len(set(label.tolist())) < 2:
        return field
    tag = toxic_tokens(t, label)
    n = len(tag)
    heads = np.zeros(n, bool)
    heads[t.first[:-1][t.first[:-1] < t.first[1:]]] = True
    known, flat = np.unique(t.features, return_inverse=True)
    flat = flat.reshape(t.features.shape)
    w, moves = np.zeros(len(known)), field.moves.copy()
    w_sum, m_sum = np.full(len(known), 1e-8), np.full(5, 1e-8)
    pairs = np.bincount((tag[:-1] * 2 + tag[1:])[~heads[1:]], minlength=4)
    for _ in range(steps):
        e = np.exp(np.clip(w[flat].sum(0), -30, 30))
        field.moves = moves
        left, right = field.forward_backward(e, t.first)
        odds = left * right
        p = odds / (1 + odds)
        gap = tag - p
        grad = sum(np.bincount(k, gap, len(known)) for k in flat) - ridge * n * w / 1000
        oo, ot, to, tt, _ = np.exp(moves)
        l, nxt = left[:-1], e[1:] * right[1:]
        joint = np.stack([np.full(n - 1, oo), ot * nxt, l * to, l * tt * nxt])
        joint = (joint / joint.sum(0))[:, ~heads[1:]].sum(1)
        step = np.append(pairs - joint, gap[heads].sum())
        w_sum += grad**2
        m_sum += step**2
        w += rate * grad / np.sqrt(w_sum)
        moves = moves + rate * step / np.sqrt(m_sum)
    w[known == 0] = 0.0
    field.weights[known], field.moves = w, moves
    return field


def rows_of(t: Tokens, chosen: np.ndarray) -> Tokens:
    """The tokens of the chosen documents only."""
    sizes = np.diff(t.first)
    keep = np.repeat(chosen, sizes)
    return Tokens(t.start[keep], t.end[keep], np.concatenate([[0], np.cumsum(sizes[chosen])]), t.features[:, keep])


def fit(t: Tokens, label: np.ndarray) -> Field:
    """The field over all documents, with the curve of a first fit over three quarters of them."""
    left_out = np.arange(len(label)) % 4 == 3
    first = fit_field(rows_of(t, ~left_out), label[~left_out])
    whole = fit_field(t, label)
    rest = rows_of(t, left_out)
    if len(set(label[left_out].tolist())) == 2:
        whole.curve = logistic(document_signs(first.marginals(rest), rest.first), label[left_out])
    elif len(set(label.tolist())) == 2:
        whole.curve = logistic(document_signs(whole.marginals(t), t.first), label)
    return whole


def joined(parts: list[Tokens]) -> Tokens:
    """The documents of all parts; starts and ends stay those within the parts."""
    sizes = [np.zeros(0, int), *(np.diff(t.first) for t in parts)]
    none = [np.zeros(0, int)]
    return Tokens(
        np.concatenate([*none, *(t.start for t in parts)]),
        np.concatenate([*none, *(t.end for t in parts)]),
        np.concatenate([[0], np.cumsum(np.concatenate(sizes))]),
        np.concatenate([np.zeros((1 + len(PREFIXES), 0), int), *(t.features for t in parts)], axis=1),
    )


def fitted(sample: DataFrame) -> Field:
    """Fit in one Spark task over (text, label) rows; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, label = [], []
        for batch in batches:
            for part, data, offsets in runs(batch, "text"):
                found.append(tokens(data, offsets))
                label += part.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in astuple(fit(joined(found), np.array(label, int)))], names=["weights", "moves", "curve"])

    row = sample.coalesce(1).mapInArrow(run, "weights binary, moves binary, curve binary").head()
    return Field(*map(np.frombuffer, row)) if row else fit_field(joined([]), np.zeros(0, int))


def tagged(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, spans) with the offending spans as (begin, end) in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for rows, data, offsets in runs(batch, "text"):
                t = tokens(data, offsets)
                p = shared.value.marginals(t)
                score = shared.value.score(p, t.first)
                spans: list[list[dict[str, int]]] = [[] for _ in score]
                hit = p >= threshold
                for row in np.flatnonzero(row_max(p, t.first) >= threshold):
                    a, b = t.first[row], t.first[row + 1]
                    # Characters before a byte: the bytes there that begin a character.
                    at = np.concatenate([[0], np.cumsum((data[offsets[row] : offsets[row + 1]] & 0xC0) != 0x80)])
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                    for x, y in zip(edges[::2], edges[1::2], strict=True):
                        spans[row].append({"begin": int(at[t.start[a + x] - offsets[row]]), "end": int(at[t.end[a + y - 1] - offsets[row]])})
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double, spans array<struct<begin:int,end:int>>")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, **columns: str) -> DataFrame:
    """Learn from ``labels.toxic`` outside the held-out fold and tag every document:
    (doc_id, held_out, score, predicted, spans)."""
    field = fitted(labelled_sample(docs, labels, "toxic", sample_rows, **columns))
    made = tagged(docs, field, threshold=threshold, **columns)
    return made.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "spans")
