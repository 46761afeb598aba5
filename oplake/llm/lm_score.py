"""Language-model scores by online logistic context mixing.

A text is coded as binary decisions.  A frequent word is its path in a Huffman tree of words;
any other is the escape leaf and its bytes, each in the Huffman tree of what follows the byte
before.  For each decision
several predictors answer: the tree itself, three tables of counts under hashed contexts (the
word before, the two words before, the class of the text so far; for bytes the two and four bytes
before, and the class with three), and a match with what followed the same two words earlier in the text.  Their
logits are mixed by weights that a gate picks (tree, confidence of the tables, match).

Training is online: a task goes through its texts once, predicts each decision from what it has
counted so far, corrects the weights by the error and counts the decision; its tables take up
new counts whenever there are twice as many as slots.  Counts of all tasks are added up, weights
averaged by how often each gate was used.  In scoring, a text starts from
these weights and goes on correcting them along its own decisions, each predicted before it is
learned from.  The total of the decisions is the text's score.

Tasks learn and score in the executors' JVM (``jvm``).  ``Decisions`` and ``Mixer`` are its form in
numpy, which the tests hold it to; the driver keeps and packs the tables with it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oplake.llm import jvm
from oplake.llm.common import Words, crc_bucket, heaviest, packed, scratch, word_chunks

#: Words with a path of their own are seen HEAD_COUNT times at least; the rest is spelled.  There are
#: HEAD of them at most, or HEAD_ROOT times the root of the training words where that is more.
HEAD, HEAD_COUNT, HEAD_ROOT = 1 << 17, 3, 28
#: Counts of so many words are broadcast for the base score; those of rarer words are joined.
KNOWN = 1 << 19
#: Classes of text, told apart by so many of the most frequent words.  They are fitted to all training
#: texts from CLASS_STARTS random starts at once, until no start's likelihood gains CLASS_GAIN of itself.
CLASSES, CLASS_WORDS, CLASS_STARTS, CLASS_ROUNDS, CLASS_GAIN = 8, 2048, 3, 25, 1e-4
#: Slots of each hashed-context table: 2^TABLE_BITS at least, and about TABLE_ROOT times the root of the training words.
TABLE_BITS, TABLE_ROOT = 20, 512
TABLES = 3
#: Training texts go through tasks of about so many characters each.
CHARS_PER_TASK = 24_000_000
#: In training, weights are corrected after each LEARN decisions.  In scoring, a text's own corrections
#: are made after FIRST_SEGMENT decisions, then after strides that grow fourfold up to SEGMENT; curvature of
#: earlier strides counts FADE as much, and PRIOR holds the corrections near 0, where the weights were learned.
LEARN = 8192
FIRST_SEGMENT, SEGMENT, FADE, PRIOR = 16, 4096, 0.9, 60.0
CHUNK = 1 << 16
#: What a byte can follow or be followed by: 256 bytes, and the start or end of the word.
FOLLOW = 257
_BLOCK = 1 << 14
_INPUTS = 6
_BIAS = 0.3
_GATES = 2 * 4**TABLES * 3
_U = np.uint64
#: Costs of a decision in nats by its logit, in steps of 1/128 between -16 and 16.
_STEP, _LIMIT = 128.0, 16.0
_COST = np.logaddexp(0.0, -np.arange(-_LIMIT, _LIMIT + 1 / _STEP, 1 / _STEP)).astype(np.float32)
_SIGNED_STEP = np.array([-_STEP, _STEP], dtype=np.float32)
_M1, _M2 = np.array([0x85EBCA6B, 0x9E3779B1], dtype=np.uint32)[:, None]  # arrays, so that products wrap silently
#: Rate of the corrections in training; one decision in CURVE is measured for their curvature.
RATE, CURVE = 0.3, 4
#: A task's tables take up new counts whenever there are so many times as many as slots.
RENEW = 2.0
#: A decision's bit as what it adds to a slot's two counts, taken as one number.
_ONE = np.array([[1, 0], [0, 1]], dtype=np.uint32).view(np.uint64).reshape(-1)
_ZSTD = pa.Codec("zstd", compression_level=1)
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F)


def table_bits(words: int) -> int:
    """Bits of a slot's number, for so many training words."""
    return max(TABLE_BITS, round(math.log2(TABLE_ROOT * math.sqrt(max(1, words)))))


def head_words(words: int) -> int:
    """Words with a path of their own at most, for so many training words."""
    return max(HEAD, int(HEAD_ROOT * math.sqrt(words)))


def gather(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values[at]``, read only, of places that are known to be there: without numpy's checks more reads are under way at once."""
    return np.asarray(pc.take(pa.array(values), pa.array(at), boundscheck=False))


class HashIndex:
    """Places of hashes in a sorted array: a direct index over their leading bits replaces a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.lead = _U(64 - max(1, min(20, len(keys).bit_length())))
        edges = np.arange((1 << (64 - int(self.lead))) + 1, dtype=np.int64)
        self.begin = np.searchsorted((keys >> self.lead).astype(np.int64), edges).astype(np.int32)
        self.most = int(np.diff(self.begin).max(initial=0))

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and whether the hashes are there."""
        at, known = np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        if not len(self.keys):
            return at, known
        place, left = np.take(self.begin, (h >> self.lead).view(np.int64)), None
        for _ in range(self.most):
            p = place if left is None else place[left]
            p = np.minimum(p, len(self.keys) - 1)
            v = np.take(self.keys, p)
            q = h if left is None else h[left]
            hit, low = v == q, v < q
            if left is None:
                at, known, left = p.astype(np.int64), hit, np.flatnonzero(low)
            else:
                at[left[hit]], known[left[hit]] = p[hit], True
                left = left[low]
            if not len(left):
                break
            place[left] += 1
        return at, known


class Codes:
    """Paths of the units in the trees: words, then escape and end; then, for each byte before (or the
    word's start), bytes and word end."""

    def __init__(self, head_hash: np.ndarray, head_count: np.ndarray, tail_count: int, ends: int, byte_count: np.ndarray, bits: int = TABLE_BITS):
        self.table_bits = bits
        order = np.argsort(head_hash)
        self.hash = head_hash[order]
        self.count = head_count[order]
        n = len(self.hash)
        self.escape, self.end, self.first_byte = n, n + 1, n + 2
        length_w, steps_w, logits_w = self._huffman(np.append(self.count, [tail_count + 1, ends + 1]))
        after = [self._huffman(row + 1) for row in byte_count.reshape(FOLLOW, FOLLOW)]
        shift = len(logits_w)
        self.length = np.concatenate([length_w, *(length for length, _, _ in after)])
        self.offset = np.cumsum(self.length) - self.length
        self.steps = np.concatenate([steps_w, *(steps + 2 * (shift + i * (FOLLOW - 1)) for i, (_, steps, _) in enumerate(after))]).astype(np.int32)
        self.logit = np.concatenate([logits_w, *(logits for _, _, logits in after)]).astype(np.float32)
        self.word_nodes = shift
        self.find = HashIndex(self.hash)
        self.class_words = np.argsort(-self.count, kind="stable")[:CLASS_WORDS]
        self.class_prior = np.zeros(1, dtype=np.float64)
        self.class_logit = np.zeros((n + 1, 1), dtype=np.float32)

    def set_classes(self, texts: list[np.ndarray]) -> None:
        """Classes of a few texts at hand.  ``texts``: places in ``class_words`` of each one's frequent words."""
        block = class_block(np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64), len(texts))
        starts = np.random.default_rng(3).choice(len(texts), min(len(texts), CLASS_STARTS * CLASSES), replace=False)
        self.fit_classes([texts[i] for i in starts], np.bincount(block[1], weights=block[2], minlength=len(self.class_words)), len(texts), lambda p, prior: class_sums(block, p, prior))

    def fit_classes(self, starts: list[np.ndarray], total: np.ndarray, texts: int, sums) -> None:
        """A mixture of unigrams over the most frequent words, fitted by expectation maximisation.
        ``starts``: texts that the classes start from; ``total``: counts of the words in all texts;
        ``sums(log_p, log_prior)``: the sums of ``class_sums`` over all texts."""
        if texts < 4 * CLASSES or len(starts) < CLASS_STARTS * CLASSES:
            return
        v = len(self.class_words)
        p = np.stack([np.bincount(t, minlength=v) for t in starts]).astype(np.float64).reshape(CLASS_STARTS, CLASSES, v)
        p += 0.5 * (total / max(1, total.sum())) * 50 + 0.01
        prior, last = np.full((CLASS_STARTS, CLASSES), 1 / CLASSES), None
        for _ in range(CLASS_ROUNDS):
            log_p, log_prior = np.log(p / p.sum(axis=2, keepdims=True)), np.log(prior)
            words, share, fit = sums(log_p, log_prior)
            p, prior = words + 0.05, (share + 1) / (texts + CLASSES)
            if last is not None and (fit - last <= CLASS_GAIN * np.abs(last)).all():
                break
            last = fit
        best = int(np.argmax(fit))
        log_p = np.log(p[best] / p[best].sum(axis=1, keepdims=True))
        self.class_prior = np.log(prior[best])
        self.class_logit = np.zeros((len(self.hash) + 1, CLASSES), dtype=np.float32)
        self.class_logit[self.class_words] = (log_p - log_p.mean(axis=0)).T

    def classes(self, unit: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The likeliest class of each token's text by the tokens before it."""
        if self.class_logit.shape[1] == 1 or not len(unit):
            return np.zeros(len(unit), dtype=np.uint64)
        each = np.take(self.class_logit, np.minimum(unit, len(self.hash)), axis=0)  # the last row is zero
        firsts = np.flatnonzero(start)
        # one running sum over the tokens before; what the texts before left is taken off at each start
        total = np.zeros((len(unit) + 1, each.shape[1]))
        np.cumsum(each, axis=0, out=total[1:])
        total = total[:-1] - np.repeat(total[firsts] - self.class_prior, np.diff(np.append(firsts, len(unit))), axis=0)
        return np.argmax(total, axis=1).astype(np.uint64)

    @staticmethod
    def _huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of the leaves' paths, the paths from the root one after another (2 * node + bit
        of each step), and each inner node's logit of bit 1."""
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        leaf, made = counts[order].tolist(), []  # both ascend, so the least two are at their fronts
        up, low, high = np.zeros(2 * n - 1, dtype=np.int64), np.zeros(n - 1), np.zeros(n - 1)
        i = j = 0
        for at in range(n - 1):
            pair = []
            for bit in range(2):
                if j == len(made) or i < n and leaf[i] <= made[j]:
                    up[order[i]] = 2 * at + bit
                    pair.append(leaf[i])
                    i += 1
                else:
                    up[n + j] = 2 * at + bit
                    pair.append(made[j])
                    j += 1
            low[at], high[at] = pair
            made.append(pair[0] + pair[1])
        root, climbs = 2 * n - 2, []
        x, left = np.arange(n), np.arange(n)
        while n > 1 and len(left):
            climbs.append((left, up[x]))
            x = n + (up[x] >> 1)
            left, x = left[x != root], x[x != root]
        length = np.zeros(n, dtype=np.int64)
        for who, _ in climbs:
            length[who] += 1
        end = np.cumsum(length) - 1
        steps = np.zeros(int(length.sum()), dtype=np.int64)
        for k, (who, step) in enumerate(climbs):
            steps[end[who] - k] = step
        return length, steps, np.log((high + 0.5) / (low + 0.5))


def class_block(text: np.ndarray, place: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of ``texts`` texts the number of its distinct words; then these words' places and counts, text by
    text.  ``text``, ``place``: of each word."""
    key, count = np.unique(text * CLASS_WORDS + place, return_counts=True)
    return np.bincount(key // CLASS_WORDS, minlength=texts), key % CLASS_WORDS, count


def class_sums(block: tuple[np.ndarray, np.ndarray, np.ndarray], log_p: np.ndarray, log_prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each start: words counted under each class, texts in each class, log likelihood."""
    starts, classes, v = log_p.shape
    size, place, count = block
    out = np.zeros((starts, classes, v)), np.zeros((starts, classes)), np.zeros(starts)
    table = np.ascontiguousarray(log_p.reshape(-1, v).T, dtype=np.float32)
    edge = np.append(0, np.cumsum(size))
    for a in range(0, len(size), 512):
        n = min(512, len(size) - a)
        w = slice(edge[a], edge[a + n])
        x = np.zeros((n, v), dtype=np.float32)
        x[np.repeat(np.arange(n), size[a : a + n]), place[w]] = count[w]
        like = (x @ table).astype(np.float64).reshape(n, starts, classes) + log_prior
        top = like.max(axis=2, keepdims=True)
        share = np.exp(like - top)
        total = share.sum(axis=2, keepdims=True)
        share /= total
        out[0][:] += (share.reshape(n, -1).T.astype(np.float32) @ x).reshape(out[0].shape)
        out[1][:] += share.sum(axis=0)
        out[2][:] += (np.log(total) + top).sum(axis=(0, 2))
    return out


class Decisions:
    """The decisions of a run of documents, in order: node, bit, document, table slots, match."""

    def __init__(self, words: Words, codes: Codes, with_match: bool):
        docs = len(words.first) - 1
        n_words = np.diff(words.first)
        total = len(words.start) + docs
        doc_of_word = np.repeat(np.arange(docs), n_words)
        place = np.arange(len(words.start)) + doc_of_word  # room for the end of each document before
        token = np.full(total, _U(1), dtype=_U)
        token[place] = words.hash
        doc = np.repeat(np.arange(docs), n_words + 1)
        unit = np.full(total, codes.end, dtype=np.int64)
        at, known = codes.find(words.hash)
        unit[place] = np.where(known, at, codes.escape)
        self.known_at, self.known, self.doc_of_word = at, known, doc_of_word

        start = np.concatenate([[True], doc[1:] != doc[:-1]]) if total else np.zeros(0, bool)
        one = np.concatenate([[_U(0)], token[:-1]]) if total else token
        one = np.where(start, _U(0), one)
        two = np.concatenate([[_U(0)], one[:-1]]) if total else token
        two = np.where(start, _U(0), two)

        tail = np.flatnonzero(~known)
        size = np.zeros(total, dtype=np.int64)
        spelled = words.end[tail] - words.start[tail]
        size[place[tail]] = spelled + 1
        first_unit = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if total else size
        n_units = int((size + 1).sum())
        units = np.empty(n_units, dtype=np.int64)
        units[first_unit] = unit
        c1, c2, c3 = (np.empty(n_units, dtype=_U) for _ in range(3))
        kind = codes.classes(unit, start)
        c3[first_unit] = (kind + _U(7)) * _K2
        c1[first_unit] = one * _K1
        c2[first_unit] = (one * _K2 + two) * _K3
        if len(tail):
            run = np.repeat(np.arange(len(tail)), spelled + 1)
            step = np.arange(len(run)) - np.repeat(np.concatenate([[0], np.cumsum(spelled + 1)[:-1]]), spelled + 1)
            b = words.bytes[np.minimum(words.start[tail][run] + step, len(words.bytes) - 1)].astype(np.int64)
            b[step == spelled[run]] = 256
            where = first_unit[place[tail]][run] + 1 + step
            last = np.concatenate([[0], b[:-1]])
            last[step == 0] = FOLLOW - 1
            units[where] = codes.first_byte + last * FOLLOW + b
            past, before = [], b.astype(_U) + _U(1)
            for k in range(1, 5):
                shifted = np.concatenate([np.zeros(min(k, len(b)), _U), before[: len(b) - k]]) if len(b) > k else np.zeros(len(b), _U)
                past.append(np.where(step >= k, shifted, _U(0)))
            low = past[0] * _U(512) + past[1]
            c1[where] = (low + _U(1 << 40)) * _K1
            c2[where] = ((past[2] * _U(512) + past[3]) * _U(1 << 18) + low + _U(1 << 50)) * _K3
            c3[where] = ((past[2] * _U(1 << 18) + low) * _U(16) + kind[place[tail]][run] + _U(1 << 60)) * _K2
        length = codes.length[units]
        n = int(length.sum())
        dec_start = np.cumsum(length) - length
        flat = np.repeat((codes.offset[units] - dec_start).astype(np.int32), length)
        flat += np.arange(n, dtype=np.int32)
        step = gather(codes.steps, flat)
        self.bit = (step & 1).astype(np.int8)
        self.node = step >> 1
        node = self.node.astype(np.uint32)
        node *= _M1 * _M2
        self.slots = []
        for c in (c1, c2, c3):  # (context + node * M1) * M2, its leading bits
            h = np.repeat((c >> _U(32)).astype(np.uint32) * _M2, length)
            h += node
            h >>= np.uint32(32 - codes.table_bits)
            self.slots.append(h.astype(np.int64))
        tok_start = dec_start[first_unit] if total else np.zeros(0, np.int64)
        self.tok_start = np.append(tok_start, n)
        self.doc_start = self.tok_start[np.append(np.flatnonzero(start), total)] if total else np.zeros(1, np.int64)
        self.match, self.matched = self._match(one, two, doc, total, n) if with_match else (None, None)

    def _match(self, one, two, doc, total, n) -> tuple[np.ndarray, np.ndarray]:
        """+1 or -1: the bit that the last token after the same two words took here, while it agrees; 0 without
        one.  And the few decisions that have one."""
        out = np.zeros(n, dtype=np.int8)
        if total < 2:
            return out, np.zeros(0, dtype=np.int64)
        key = (one * _K2 + two) * _K3 + doc.astype(_U) * _K1
        # sorted by the leading bits, with the place in the others; equal keys lie together, in order
        low = _U((1 << total.bit_length()) - 1)
        order = (np.sort(key & ~low | np.arange(total, dtype=_U)) & low).astype(np.int64)
        same = (key[order][1:] == key[order][:-1]) & (one[order][1:] != 0)
        prev = np.full(total, -1, dtype=np.int64)
        prev[order[1:][same]] = order[:-1][same]
        has = np.flatnonzero(prev >= 0)
        if not len(has):
            return out, has
        s, e = self.tok_start[has], self.tok_start[has + 1]
        ps, pe = self.tok_start[prev[has]], self.tok_start[prev[has] + 1]
        size = np.minimum(e - s, pe - ps)
        base = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(base, size)
        here, there = np.repeat(s, size) + step, np.repeat(ps, size) + step
        differs = self.bit[here] != self.bit[there]
        wrong = np.cumsum(differs, dtype=np.int32) - differs  # mismatches before this decision
        wrong = wrong - np.repeat(wrong[base], size)
        ok = wrong == 0
        out[here[ok]] = 2 * self.bit[there[ok]] - 1
        return out, here[ok]


#: Confidence by how often a slot was counted, up to 16 times.
_CONFIDENCE = np.array([0, 1, 1, *[2] * 13, 3], dtype=np.int16)


def _pack(none: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Counts as predictions read them: the logit in steps of 1/256, with the confidence in the two low bits."""
    step = np.log(one.astype(np.float32) + np.float32(0.4))
    step -= np.log(none.astype(np.float32) + np.float32(0.4))
    step *= np.float32(256)
    packed_ = np.rint(step, out=step).astype(np.int16)
    packed_ <<= 2
    packed_ |= np.take(_CONFIDENCE, np.minimum(one, 16) + np.minimum(none, 16), mode="clip")
    return packed_


#: The same for all counts below _FEW, by none * _FEW + one.
_FEW = 64
_PACKED = _pack(*np.divmod(np.arange(_FEW * _FEW, dtype=np.uint32), np.uint32(_FEW)))


@dataclass
class Mixer:
    codes: Codes
    counts: list[np.ndarray]  # of each table: [slot, bit] as uint32; none where the mixer only scores
    weights: np.ndarray  # [gate, input]

    def __post_init__(self):
        size = 1 << self.codes.table_bits
        self._ready = [np.zeros(size, dtype=np.int16) for _ in range(TABLES)]
        self.used = np.zeros(_GATES)  # how many decisions each gate has learned from
        self.steps = 0
        self._since = 0  # decisions counted since the tables were last renewed

    @staticmethod
    def start(codes: Codes) -> Mixer:
        return Mixer(codes, [np.zeros((1 << codes.table_bits, 2), dtype=np.uint32) for _ in range(TABLES)], _initial_weights())

    def renew(self) -> None:
        """Takes the counts into what predictions read."""
        for k, c in enumerate(self.counts):
            for a in range(0, len(c), 1 << 16):
                none, one = c[a : a + (1 << 16), 0], c[a : a + (1 << 16), 1]
                packed_ = np.take(_PACKED, np.minimum(none, _FEW - 1) * np.uint32(_FEW) + np.minimum(one, _FEW - 1))
                many = np.flatnonzero((none | one) >= _FEW)
                packed_[many] = _pack(none[many], one[many])
                self._ready[k][a : a + len(packed_)] = packed_
        self._since = 0

    def for_scoring(self) -> Mixer:
        """The same without the counts, which only training needs."""
        self.renew()
        out = Mixer(self.codes, [], self.weights)
        out._ready = self._ready
        return out

    def inputs(self, d: Decisions) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each input, the last one constant, and the gate of each decision."""
        x = np.empty((_INPUTS, len(d.bit)), dtype=np.float32)
        x[0] = gather(self.codes.logit, d.node)
        gate = (d.node >= self.codes.word_nodes).astype(np.int16)
        for k, slot in enumerate(d.slots):
            v = gather(self._ready[k], slot)
            gate <<= 2
            gate += v & 3
            np.multiply(v >> 2, np.float32(1 / 256), out=x[1 + k])
        x[-2], x[-1] = d.match, _BIAS
        long = (d.match != 0).astype(np.int16)
        first = d.tok_start[:-1][d.tok_start[:-1] < len(long)]
        long[first] *= 2  # a match is less sure at a token's first decision
        gate *= 3
        gate += long
        return x, gate.astype(np.intp)

    @staticmethod
    def logits(x: np.ndarray, gate: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mixed logits; ``at``: the decisions with a match."""
        w = np.ascontiguousarray(weights.T, dtype=np.float32)
        z = np.take(w[-1] * np.float32(_BIAS), gate, mode="clip")
        for k in range(len(x) - 2):
            t = np.take(w[k], gate, mode="clip")
            t *= x[k]
            z += t
        z[at] += w[-2][gate[at]] * x[-2][at]
        return np.minimum(np.maximum(z, -_LIMIT, out=z), _LIMIT, out=z)

    def learn(self, words: Words) -> int:
        """Goes through a run of training documents: predicts, corrects the weights, counts."""
        d = Decisions(words, self.codes, True)
        x, gate = self.inputs(d)
        self.used += np.bincount(gate, minlength=_GATES)
        for a in range(0, len(gate), LEARN):
            xs, g, bits = x[:, a : a + LEARN], gate[a : a + LEARN], d.bit[a : a + LEARN]
            at = d.matched[slice(*np.searchsorted(d.matched, (a, a + LEARN)))] - a
            p = 1 / (1 + np.exp(-self.logits(xs, g, self.weights, at)))
            some = slice(self.steps % CURVE, None, CURVE)  # curvature changes slowly: a share of the decisions tells it
            h, gs, err = (p[some] * (1 - p[some])) * np.float32(CURVE), g[some], bits - p
            v = xs[:-2, some] * xs[:-2, some] * h
            up, down = np.zeros((2, _INPUTS, _GATES))
            for k in range(_INPUTS - 2):
                up[k] = np.bincount(g, weights=err * xs[k], minlength=_GATES)
                down[k] = np.bincount(gs, weights=v[k], minlength=_GATES)
            told = at[at % CURVE == some.start] // CURVE
            up[-2] = np.bincount(g[at], weights=err[at] * xs[-2, at], minlength=_GATES)
            down[-2] = np.bincount(gs[told], weights=h[told], minlength=_GATES)
            up[-1] = _BIAS * np.bincount(g, weights=err, minlength=_GATES)
            down[-1] = _BIAS**2 * np.bincount(gs, weights=h, minlength=_GATES)
            self.weights += (RATE * up / (_INPUTS * 0.5 * down + 20.0)).T
            self.steps += 1
        count = np.take(_ONE, d.bit)
        for k, slot in enumerate(d.slots):
            np.add.at(self.counts[k].view(np.uint64).reshape(-1), slot, count)
        self._since += len(gate)
        if self._since >= RENEW * len(self.counts[0]):
            self.renew()
        return len(gate)

    @staticmethod
    def costs(z: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Nats of each decision; the two answers of a decision have probabilities that add up to 1."""
        at = np.take(_SIGNED_STEP, bit)
        at *= z
        np.rint(at, out=at)
        at += np.float32(_LIMIT * _STEP)
        return np.take(_COST, at.astype(np.intp), mode="clip")

    def score(self, words: Words) -> tuple[np.ndarray, Decisions]:
        """log10 of each document's probability.  The weights are corrected along each document: after
        every stride all of them move by the errors of its decisions, and the next stride is
        predicted with them."""
        d = Decisions(words, self.codes, True)
        x, gate = self.inputs(d)
        z = self.logits(x, gate, self.weights, d.matched)
        for a, b in zip(d.doc_start[:-1].tolist(), d.doc_start[1:].tolist()):
            own, curve = np.zeros(_INPUTS, dtype=np.float32), np.zeros(_INPUTS, dtype=np.float32)
            s, size = a, FIRST_SEGMENT
            while s + size < b:  # nothing comes after the last stride
                xs, r = x[:, s : s + size], z[s : s + size]
                p = 1 / (1 + np.exp(-r))
                curve *= FADE
                curve += (xs * xs) @ (p * (1 - p))
                own += (xs @ (d.bit[s : s + size] - p)) / (_INPUTS * 0.5 * curve + PRIOR)
                np.minimum(np.maximum(own, -1.0, out=own), 1.0, out=own)
                s, size = s + size, min(4 * size, SEGMENT)
                nxt = z[s : min(b, s + size)]
                nxt += own @ x[:, s : min(b, s + size)]
                np.minimum(np.maximum(nxt, -_LIMIT, out=nxt), _LIMIT, out=nxt)
        out = np.add.reduceat(self.costs(z, d.bit), d.doc_start[:-1], dtype=np.float64)  # each document has a decision at least
        return -out / math.log(10), d


def _initial_weights() -> np.ndarray:
    return np.tile(np.array([0.3, 0.25, 0.25, 0.4, 1.0, 0.0]), (_GATES, 1))


def byte_pairs(words: Words) -> np.ndarray:
    """How often each byte of a word, or its end, follows each other byte, or the word's start."""
    b = words.bytes.astype(np.int64)
    last = np.empty_like(b)
    last[1:] = b[:-1]
    last[words.start] = FOLLOW - 1
    last *= FOLLOW
    last += b
    edge = np.zeros(len(b) + 1, dtype=np.int8)
    edge[words.start] += 1
    edge[words.end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    if len(words.start):
        inside[words.start] = True  # words of two documents may touch
    ends = b[words.end - 1] * FOLLOW + FOLLOW - 1 if len(words.start) else last[:0]
    return np.bincount(last[inside], minlength=FOLLOW * FOLLOW) + np.bincount(ends, minlength=FOLLOW * FOLLOW)


def word_counts(train: DataFrame) -> DataFrame:
    """(kind, h, c): counts of word hashes (0), pairs of bytes (1) and documents (2) over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, waiting = [], 0
        held, rows = [], 0
        octets, docs = np.zeros(FOLLOW * FOLLOW, np.int64), 0

        def add():
            nonlocal waiting, rows
            if raw:
                held.append(np.unique(np.concatenate(raw), return_counts=True))
                rows += len(held[-1][0])
                raw.clear()
                waiting = 0

        def flush():
            h, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(inverse, weights=np.concatenate([c for _, c in held])).astype(np.int64)

        def out(kind, h, c):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(c)], names=["kind", "h", "c"])

        for batch in batches:
            docs += len(batch)
            for _, _, words in word_chunks(batch.column(0)):
                raw.append(words.hash)
                waiting += len(words.hash)
                if waiting > 1_500_000:
                    add()
                octets += byte_pairs(words)
            if rows > 2_000_000:
                held[:] = [flush()]
                rows = len(held[0][0])
                if rows > 1_000_000:
                    yield out(0, held[0][0].view(np.int64), held[0][1])
                    held, rows = [], 0
        add()
        if held:
            h, c = flush()
            yield out(0, h.view(np.int64), c)
        pairs = np.flatnonzero(octets)
        yield out(1, pairs, octets[pairs])
        yield out(2, np.zeros(1, np.int64), np.array([docs], np.int64))

    return train.mapInArrow(run, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c"))


def learn_classes(train: DataFrame, codes: Codes, texts: int) -> None:
    """Fits the classes of ``codes`` to all training texts (a column): their frequent words are kept
    packed, and a round adds up each task's sums."""
    rank = np.argsort(codes.hash[codes.class_words])
    keys = codes.hash[codes.class_words[rank]]
    find = HashIndex(keys)
    if not len(keys) or texts < 4 * CLASSES:
        return

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in word_chunks(batch.column(0)):
                at, ok = find(words.hash)
                text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
                block = class_block(text[ok], rank[at[ok]], len(words.first) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(block, ("<i4", "<i2", "<i4"))], names=["n", "w", "c"])

    def block_of(batch: pa.RecordBatch, i: int):
        return tuple(np.frombuffer(batch.column(k)[i].as_py(), dtype=t) for k, t in enumerate(("<i4", "<i2", "<i4")))

    packed = scratch(train.mapInArrow(pack, "n binary, w binary, c binary"), "lm-classes")

    def sums(log_p: np.ndarray, log_prior: np.ndarray):
        shape = log_p.shape
        shared = train.sparkSession.sparkContext.broadcast((log_p, log_prior))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = None
            for batch in batches:
                for i in range(len(batch)):
                    words, share, fit = class_sums(block_of(batch, i), *shared.value)
                    more = np.concatenate([words.reshape(-1, shape[2]), share.reshape(-1, 1), np.repeat(fit, shape[1])[:, None]], axis=1)
                    own = more if own is None else own + more
            if own is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own), dtype=np.int32)), pa.array([x.tobytes() for x in own], pa.binary())], names=["i", "v"])

        def add(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"i": part["i"].iloc[:1], "v": [sum(np.frombuffer(bytes(v)) for v in part["v"]).tobytes()]})

        out = np.zeros((shape[0] * shape[1], shape[2] + 2))
        for r in packed.mapInArrow(run, "i int, v binary").groupBy("i").applyInPandas(add, "i int, v binary").collect():
            out[r.i] = np.frombuffer(bytes(r.v))
        shared.unpersist()
        return out[:, :-2].reshape(shape), out[:, -2].reshape(shape[:2]), out[:: shape[1], -1]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the texts of least hash in each task: a start only needs texts that differ
        for batch in batches:
            for i in range(len(batch)):
                size, place, count = block_of(batch, i)
                edge, out = np.append(0, np.cumsum(size)), []
                total = np.bincount(place, weights=count, minlength=len(keys))
                for t in np.flatnonzero(size >= 4):
                    w = np.repeat(place[edge[t] : edge[t + 1]], count[edge[t] : edge[t + 1]]).astype("<i2").tobytes()
                    out.append((zlib.crc32(w), w))
                out = sorted(set(out))[: CLASS_STARTS * CLASSES]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([w for _, w in out], pa.binary()), pa.nulls(len(out), pa.binary())], names=["h", "w", "total"])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["h", "w", "total"])

    firsts = scratch(packed.mapInArrow(first, "h long, w binary, total binary"), "lm-starts")
    starts = [np.frombuffer(bytes(r.w), dtype="<i2") for r in firsts.where("h is not null").select("h", "w").distinct().orderBy("h", "w").limit(CLASS_STARTS * CLASSES).collect()]
    total = np.zeros(len(keys))
    for r in firsts.where("total is not null").select("total").toLocalIterator():
        total += np.frombuffer(bytes(r.total), dtype="<f8")
    codes.fit_classes(starts, total, texts, sums)


def learn_model(train: DataFrame, codes: Codes, tasks: int) -> Mixer:
    """Tables and weights from one pass over all training texts.  Tasks send compressed blocks, which
    are added up 32 tasks at a time, so no task or driver step holds more than that."""
    size = 1 << codes.table_bits
    engine = jvm.engine(train.sparkSession, _arrays(codes, _initial_weights()))
    fields = "b int, task long, v binary"

    def add(part: pd.DataFrame) -> pd.DataFrame:
        if part["b"].iloc[0] < 0:
            total = sum(np.frombuffer(_unpress(bytes(v))) for v in part["v"]).tobytes()
        else:
            total = _narrow(sum(_wide(_unpress(bytes(v))) for v in part["v"]))
        return pd.DataFrame({"b": part["b"].iloc[:1].astype("int32"), "task": part["task"].iloc[:1], "v": [_press(total)]})

    now = jvm.map_rows(train.select(F.col(train.columns[0]).cast("binary")), engine.learner(), fields)
    left = tasks
    while left > 32:
        left = math.ceil(left / 32)
        now = scratch(now.withColumn("g", F.pmod(F.xxhash64("task"), F.lit(left))).groupBy("b", "g").applyInPandas(add, fields), "lm-blocks")
    out = Mixer.start(codes)
    per = size // _BLOCK
    for r in scratch(now.groupBy("b").applyInPandas(add, fields), "lm-tables").toLocalIterator():
        if r.b < 0:
            weights = np.frombuffer(_unpress(bytes(r.v))).reshape(_GATES, 1 + _INPUTS)
            seen = weights[:, 0] > 0
            out.weights[seen] = weights[seen, 1:] / weights[seen, :1]
        else:
            i = (r.b % per) * _BLOCK
            out.counts[r.b // per][i : i + _BLOCK] = np.minimum(_wide(_unpress(bytes(r.v))), 0xFFFFFFFF).astype(np.uint32).reshape(-1, 2)
    engine.done()
    return out


def _arrays(codes: Codes, weights: np.ndarray) -> list[np.ndarray]:
    """What ``jvm`` has to know of the codes and parameters."""
    numbers = [codes.table_bits, codes.word_nodes, codes.first_byte, codes.class_logit.shape[1], _GATES, LEARN, CURVE, _BLOCK, FIRST_SEGMENT, SEGMENT, _FEW]
    parameters = [RATE, RENEW, _BIAS, _LIMIT, _STEP, FADE, PRIOR]
    paths = [codes.length.astype(np.int32), codes.offset.astype(np.int32), codes.steps, codes.logit]
    return [np.array(numbers, np.int64), np.array(parameters), codes.hash, *paths, codes.class_logit, codes.class_prior, weights, _PACKED, _COST]


def scoring_engine(spark: SparkSession, mix: Mixer, known_hash: np.ndarray, known_count: np.ndarray):
    """``known_hash``, ``known_count``: of the words whose counts are broadcast."""
    logs = [np.log10(mix.codes.count + 1.0), known_hash, np.log10(known_count + 1.0)]
    return jvm.engine(spark, [*_arrays(mix.codes, mix.weights), *mix._ready, *logs])


def _press(data: bytes) -> bytes:
    """Compressed, behind the size."""
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _unpress(data: bytes) -> bytes:
    return _ZSTD.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts as bytes, in the fewest that hold the largest; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << (8 * w) - (w == 8))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def score_documents(docs: DataFrame, holdout: tuple[int, int] = (7, 2), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from rows whose crc32(id) mod ``holdout[0]`` is not ``holdout[1]``; A-Z are lower-cased;
    a text's tokens are its words and one end.  Null and empty texts are the end alone.  Without
    training rows every decision is even.  Repeated rows repeat; an empty table gives no rows;
    other columns are ignored.  What is broadcast, the most frequent words and the tables, grows
    with the root of the training words.  Counts of rarer words are joined, not broadcast.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    train = base.where(crc_bucket(F.col("doc_id"), holdout[0]) != holdout[1])
    counts = scratch(word_counts(train.select("text")), "lm-counts")
    totals = {r.kind: r for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    octets = np.zeros(FOLLOW * FOLLOW, dtype=np.int64)
    at, n = packed(counts.where("kind = 1").select("h", "c"))
    octets[at] = n
    n_docs = totals[2].n if 2 in totals else 0
    n_words, v_words = (totals[0].n, totals[0].v) if 0 in totals else (0, 0)
    n_train, v_train = n_words + n_docs, v_words + (1 if n_docs else 0)
    known_hash, known_count = heaviest(counts.where("kind = 0").select("h", "c"), max(KNOWN, head_words(n_words)))
    known_hash = known_hash.view(np.uint64)
    order = np.argsort(-known_count, kind="stable")
    order = order[known_count[order] >= HEAD_COUNT][: head_words(n_words)]
    head_hash, head_count = known_hash[order], known_count[order]
    codes = Codes(head_hash, head_count, int(n_words - head_count.sum()), n_docs, octets, table_bits(n_words))
    learn_classes(train.select("text"), codes, n_docs)
    tasks = max(6, math.ceil(int(octets.sum()) / CHARS_PER_TASK))
    engine = scoring_engine(spark, learn_model(train.select("text").coalesce(tasks), codes, tasks).for_scoring(), known_hash, known_count)
    per_token = math.log10(n_train + v_train + 1)
    end_part = math.log10(n_docs + 1)

    # a row of each document (h null), then rows of its words outside what is broadcast, under one uid
    fields = f"uid long, h long, doc_id {kind}, n_tokens long, n_known long, part double, score double, octets long"
    scored = scratch(jvm.map_rows(base.select("doc_id", F.col("text").cast("binary")), engine.scorer(), fields), "lm-scored")
    engine.done()
    rare = scored.where("h is not null").select("uid", "h").join(counts.where("kind = 0").select("h", "c"), "h")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("found"))
    end_known = 1 if n_docs else 0
    return (
        scored.where("h is null")
        .join(rare, "uid", "left")
        .select(
            "doc_id",
            (crc_bucket(F.col("doc_id"), holdout[0]) == holdout[1]).alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("found", F.lit(0)) + end_known).alias("n_known"),
            F.lit(n_train).cast("long").alias("train_tokens"),
            (F.col("part") + end_part + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
            "score",
            (-F.col("score") * math.log2(10) / F.greatest(F.col("octets"), F.lit(1))).alias("bits_per_byte"),
        )
    )
