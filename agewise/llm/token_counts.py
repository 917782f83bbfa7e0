"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

Texts are cut into pre-tokens at white space, each with the word-start mark in front (a word longer than
``MAX_BYTES`` is cut at a character boundary into pre-tokens without it).  A pre-token's tokens are
those of its best-scoring split into vocabulary pieces, and of these the one with fewest; bytes that no
piece covers cost a byte piece each.  A task inserts the distinct pre-tokens it has not met yet in a trie, level by
level; every node, a shared prefix, gets the forward score (best score and fewest tokens up to there)
once, from its ancestors; the terminal nodes' counts are kept and looked up for every occurrence.

The vocabulary is a file of the sentencepiece kind, read where the job starts and sent to all tasks;
its size is checked.  Whole-number scores (ranks, as in merge-based files) become Zipf log
probabilities, ``-ln(rank + 2)``.  No shuffle.  Defined results: null or empty texts have no tokens;
repeated rows agree; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from agewise.llm.frames import bytes_and_offsets, keyed, original_id, slices
from agewise.llm.hashing import PIECE, U, mix, word_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MAX_PIECES = 1 << 20
MAX_BYTES = 96
#: Distinct pre-tokens that one trie holds, and whose counts a task remembers.
TRIE, REMEMBERED = 20_000, 1 << 20
_MARK = "▁".encode()
_B = U(0x9E3779B97F4A7C55)
_FILTER_BITS = 22


def load_vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    """Piece and log probability; the word-start mark is part of a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    if n > MAX_PIECES:
        raise ValueError(f"a vocabulary of {n} pieces is too large to send to every task")
    ids = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i).encode(): model.get_score(i) for i in ids}
    if all(s == int(s) for s in scores.values()):
        scores = {p: -math.log(2 - s) for p, s in scores.items()}
    return scores


class Pieces:
    """The vocabulary by length, as sorted hashes behind a bit filter."""

    def __init__(self, scores: dict[bytes, float]):
        by: dict[int, list] = {}
        for piece, s in scores.items():
            h = U(0)
            with np.errstate(over="ignore"):
                for c in piece:
                    h = h * _B + U(c + 1)
            by.setdefault(len(piece), []).append((int(mix(np.array([h], U))[0]), s))
        self.fallback = min(scores.values(), default=0.0) - 5.0
        self.lengths, self._keys, self._scores = sorted(by), {}, {}
        self._maybe = np.zeros(1 << _FILTER_BITS, bool)
        for n, rows in by.items():
            rows.sort()
            self._keys[n] = np.array([k for k, _ in rows], U)
            self._scores[n] = np.array([s for _, s in rows])
            self._maybe[(self._keys[n] >> U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces of ``n`` bytes, and their scores."""
        h = mix(h)
        at = np.flatnonzero(self._maybe[(h >> U(64 - _FILTER_BITS)).astype(np.int64)])
        keys = self._keys[n]
        k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        ok = keys[k] == h[at]
        return at[ok], self._scores[n][k[ok]]


def forward(chars: np.ndarray, length: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and score of each pre-token (a row of ``chars``, ``length`` bytes of it); trie nodes visited."""
    n, depth = chars.shape
    prefix = np.zeros((depth + 1, n), U)
    score, count = np.zeros((depth + 1, n)), np.zeros((depth + 1, n), np.int32)
    power = np.multiply.accumulate(np.concatenate(([U(1)], np.full(max(pieces.lengths, default=1), _B))))
    nodes = 0
    for d in range(1, depth + 1):
        live = np.flatnonzero(length >= d)
        prefix[d, live] = prefix[d - 1, live] * _B + (chars[live, d - 1].astype(U) + U(1))
        _, first, member = np.unique(prefix[d, live], return_index=True, return_inverse=True)
        node = live[first]  # one word for each node of this level
        nodes += len(node)
        best, fewest = score[d - 1, node] + pieces.fallback, count[d - 1, node] + 1
        for k in pieces.lengths:
            if k > d:
                break
            at, s = pieces.find(k, prefix[d, node] - prefix[d - k, node] * power[k])
            if len(at):
                s, c = s + score[d - k, node[at]], count[d - k, node[at]] + 1
                better = (s > best[at] + 1e-9) | ((np.abs(s - best[at]) <= 1e-9) & (c < fewest[at]))
                best[at[better]], fewest[at[better]] = s[better], c[better]
        score[d, live], count[d, live] = best[member.ravel()], fewest[member.ravel()]
    row = np.arange(n)
    return count[length, row], score[length, row], nodes


def pre_tokens(data: np.ndarray, offsets: np.ndarray):
    """Start, end, row and whether it starts a word, of every pre-token."""
    _, start, end, row = word_hashes(data, offsets, lower=False)
    long = np.flatnonzero(end - start > MAX_BYTES)
    if not len(long):
        return start, end, row, np.ones(len(start), bool)
    out, done = [], 0
    for i in long:
        out.append((start[done:i], end[done:i], row[done:i], np.ones(i - done, bool)))
        cuts = [int(start[i])]
        while end[i] - cuts[-1] > MAX_BYTES:
            c = cuts[-1] + MAX_BYTES
            while c > cuts[-1] + 1 and data[c] & 0xC0 == 0x80:
                c -= 1
            cuts.append(c)
        first = np.zeros(len(cuts), bool)
        first[0] = True
        out.append((np.array(cuts), np.array([*cuts[1:], end[i]]), np.full(len(cuts), row[i]), first))
        done = i + 1
    out.append((start[done:], end[done:], row[done:], np.ones(len(start) - done, bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _solve(data, start, end, is_first, pieces):
    """Tokens and scores of distinct pre-tokens, in tries of bounded size; words of like length together."""
    tokens, scores = np.zeros(len(start), np.int32), np.zeros(len(start))
    order = np.lexsort((end - start, ~is_first))
    for group in np.split(order, np.flatnonzero(np.diff(is_first[order].astype(int))) + 1):
        for a in range(0, len(group), TRIE):
            g = group[a:a + TRIE]
            n = end[g] - start[g]
            lead = _MARK if is_first[g[0]] else b""
            chars = np.zeros((len(g), len(lead) + int(n.max())), np.uint8)
            chars[:, :len(lead)] = np.frombuffer(lead, np.uint8)
            at = start[g][:, None] + np.arange(int(n.max()))
            chars[:, len(lead):] = data[np.minimum(at, len(data) - 1)]
            tokens[g], scores[g], _ = forward(chars, n + len(lead), pieces)
    return tokens, scores


def _count(pieces):
    schema = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches):
        from agewise.llm.hashing import Fingerprints, byte_values
        p = pieces.value
        known, known_tokens, known_scores = np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0)
        for b in batches:
            data, off = bytes_and_offsets(b.column("text"))
            n = [np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)]
            for a, z in slices(off, 4 * PIECE):
                part = data[off[a]:off[z]]
                start, end, row, first = pre_tokens(part, off[a:z + 1] - off[a])
                if not len(start):
                    continue
                h = Fingerprints(byte_values(False)[part])(start, end) ^ first.astype(U)
                distinct, at, which = np.unique(h, return_index=True, return_inverse=True)
                k = np.searchsorted(known, distinct)
                met = np.zeros(len(distinct), bool)
                if len(known):
                    met = known[np.minimum(k, len(known) - 1)] == distinct
                tokens, scores = np.zeros(len(distinct), np.int32), np.zeros(len(distinct))
                tokens[met], scores[met] = known_tokens[k[met]], known_scores[k[met]]
                new = np.flatnonzero(~met)
                if len(new):
                    tokens[new], scores[new] = _solve(part, start[at[new]], end[at[new]], first[at[new]], p)
                    if len(known) + len(new) > REMEMBERED:
                        known, known_tokens, known_scores = known[:0], known_tokens[:0], known_scores[:0]
                    all_h = np.concatenate([known, distinct[new]])
                    order = np.argsort(all_h)
                    known = all_h[order]
                    known_tokens = np.concatenate([known_tokens, tokens[new]])[order]
                    known_scores = np.concatenate([known_scores, scores[new]])[order]
                w = which.ravel()
                m = z - a
                n[0][a:z] = np.bincount(row, minlength=m)
                n[1][a:z] = np.bincount(row, tokens[w], minlength=m)
                n[2][a:z] = np.bincount(row, scores[w], minlength=m)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tie"), *map(pa.array, n)], schema=schema)
    return run


def count_tokens(docs: DataFrame, vocabulary: dict[bytes, float]) -> DataFrame:
    """``(id, tie, n_pretokens, n_tokens, score)`` of every row; score: the splits' summed log probability."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(vocabulary))
    return keyed(docs).mapInArrow(_count(pieces), "id long, tie long, n_pretokens long, n_tokens long, score double")


def op5_token_counts(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts of all ``documents``."""
    out = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_vocabulary(vocabulary))
    return out.select(original_id().alias("doc_id"), "n_pretokens", "n_tokens", "score")
