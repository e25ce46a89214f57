"""Linear-chain conditional random field over the words of whole texts (numpy).

A word's score for each label is the sum of the weights of its hashed features: the word
itself (lexicon), and its character n-grams of 1 to 5 bytes with marked ends (affixes are
the n-grams that hold an end mark). Labels of neighbouring words are tied by learned
transitions; marginals come from forward-backward. Texts of a batch run side by side: at
word t all texts that still have a word t take one vector step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BITS = 18
NGRAMS = (1, 2, 3, 4, 5)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: ASCII characters other than letters become blanks; letters lower-cased before.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of text handled at once by ``marginals``; a longer text is a step of its own.
STEP_BYTES = 1_000_000
#: Distinct words whose features are held in one block while training.
TRAIN_WORDS = 20_000


def text_words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and non-ASCII characters."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of the words one after another, number of features of each word)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buf = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(buf))  # bytes of the word from here on
    feats, owner = [], []
    acc = np.zeros(len(buf), np.uint64)
    for n in NGRAMS:
        shifted = np.zeros(len(buf), np.uint64)
        shifted[:len(buf) - n + 1] = buf[n - 1:]
        acc = acc * np.uint64(257) + shifted
        ok = left >= n
        h = (acc[ok] + np.uint64(n << 56)) * _ODD
        feats.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        owner.append(word[ok])
    whole = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - BITS)
    feats.append(whole.astype(np.int64))
    owner.append(np.arange(len(words)))
    f, o = np.concatenate(feats), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return f[order], np.bincount(o, minlength=len(words))


def distinct(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    coded = pa.array(words, pa.binary()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Crf:
    weights: np.ndarray  # (2 ** BITS, labels)
    bias: np.ndarray
    transitions: np.ndarray  # from, to

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Label scores of distinct words."""
        out = np.empty((len(words), len(self.bias)), np.float32)
        for at in range(0, len(words), 50_000):
            f, n = word_features(words[at:at + 50_000])
            if len(f):
                out[at:at + 50_000] = (np.add.reduceat(self.weights[f], np.cumsum(n) - n, axis=0)
                                       / np.sqrt(n)[:, None] + self.bias)
        return out


def time_major(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of these lengths, side by side: the order of their words by place (longest
    text first within a place), and how many texts have each place."""
    rank = np.empty(len(lens), np.int64)
    rank[np.argsort(-lens, kind="stable")] = np.arange(len(lens))
    place = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    order = np.lexsort((np.repeat(rank, lens), place))
    return order, np.bincount(place)


def forward_backward(em: np.ndarray, transitions: np.ndarray, active: np.ndarray
                     ) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of time-major words, expected transitions and the log partition. Two arrays of
    the size of ``em`` are held at once: the marginals take the place of the forward values."""
    top = em.max(axis=1, keepdims=True)
    e = (em - top).astype(np.float64, copy=False)
    log_top = top.sum()
    del em, top
    np.exp(e, out=e)
    T = np.exp(transitions.astype(np.float64))
    at = np.concatenate(([0], np.cumsum(active)))
    alpha, scale = np.empty_like(e), np.empty(len(e))
    for t in range(len(active)):
        lo, hi = at[t], at[t + 1]
        a = e[lo:hi].copy() if t == 0 else alpha[at[t - 1]:at[t - 1] + hi - lo] @ T * e[lo:hi]
        s = a.sum(axis=1)
        alpha[lo:hi] = a / s[:, None]
        scale[lo:hi] = s
    moves = np.zeros_like(T)
    after = np.ones((active[-1] if len(active) else 0, e.shape[1]))  # backward values of the place behind
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        nxt = e[at[t + 1]:at[t + 1] + n] * after / scale[at[t + 1]:at[t + 1] + n, None]
        after = np.ones((active[t], e.shape[1]))
        after[:n] = nxt @ T.T
        moves += alpha[at[t]:at[t] + n].T @ nxt
        alpha[at[t]:at[t + 1]] *= after
    return alpha, moves * T, float(np.log(scale, out=scale).sum() + log_top)


def coded(texts: list[str | None]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words of the texts, and each text as numbers of words."""
    number: dict[bytes, int] = {}
    out = [np.fromiter((number.setdefault(w, len(number)) for w in text_words(t)), np.int32) for t in texts]
    return list(number), out


def train(vocabulary: list[bytes], texts: list[np.ndarray], labels: list[np.ndarray], n_labels: int,
          steps: int = 60, rate: float = 0.5, l2: float = 1e-6) -> Crf:
    """Maximum likelihood by Adagrad over all texts (as of ``coded``) at once (deterministic).
    Features are gone through in blocks of words, which bounds the memory of a step."""
    keep = [i for i, w in enumerate(texts) if len(w)]
    lens = np.array([len(texts[i]) for i in keep], np.int64)
    model = Crf(np.zeros((1 << BITS, n_labels), np.float32), np.zeros(n_labels, np.float32),
                np.zeros((n_labels, n_labels), np.float32))
    if not keep:
        return model
    present, code = np.unique(np.concatenate([texts[i] for i in keep]), return_inverse=True)
    n_words = len(present)
    gold = np.concatenate([labels[i] for i in keep]).astype(np.int32)
    order, active = time_major(lens)
    code = code.astype(np.int32)[order]
    at_gold = np.arange(len(code)) * n_labels + gold[order]
    del order
    blocks = []  # (words from, to, features, their number for each word)
    for at in range(0, n_words, TRAIN_WORDS):
        f, n = word_features([vocabulary[i] for i in present[at:at + TRAIN_WORDS]])
        blocks.append((at, at + len(n), f.astype(np.int32), n))
    used = np.unique(np.concatenate([np.unique(f) for _, _, f, _ in blocks]))
    blocks = [(lo, hi, np.searchsorted(used, f).astype(np.int32), n) for lo, hi, f, n in blocks]
    w = np.zeros((len(used), n_labels))
    b, T = np.zeros(n_labels), np.zeros((n_labels, n_labels))
    inner = np.ones(len(gold), bool)
    inner[np.cumsum(lens) - lens] = False
    to = np.flatnonzero(inner)
    seen = np.bincount(gold[to - 1] * n_labels + gold[to], minlength=n_labels ** 2).reshape(n_labels, n_labels)
    del gold, inner, to
    grads = [np.full_like(x, 1e-8) for x in (w, b, T)]
    for _ in range(steps):
        em = np.empty((n_words, n_labels))
        for lo, hi, f, n in blocks:
            em[lo:hi] = np.add.reduceat(w[f], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None] + b
        d, moves, _ = forward_backward(em[code], T, active)
        d.reshape(-1)[at_gold] -= 1
        d /= len(code)
        by_word = np.stack([np.bincount(code, d[:, k], n_words) for k in range(n_labels)], axis=1)
        gw = l2 * w
        for lo, hi, f, n in blocks:
            own = by_word[lo:hi] / np.sqrt(n)[:, None]
            for k in range(n_labels):
                gw[:, k] += np.bincount(f, np.repeat(own[:, k], n), len(used))
        del d
        for x, gx, s in ((w, gw, grads[0]), (b, by_word.sum(axis=0), grads[1]),
                         (T, (moves - seen) / len(code) + 1e-4 * T, grads[2])):
            s += gx * gx
            x -= rate * gx / np.sqrt(s)
    model.weights[used] = w
    model.bias, model.transitions = b.astype(np.float32), T.astype(np.float32)
    return model


def marginals(model: Crf, texts: list[str | None]):
    """Yields, for slices of the texts in turn, (word counts, label probabilities of their
    words one text after another)."""
    def run(part: list[list[bytes]]):
        lens = np.array([len(w) for w in part], np.int64)
        if not lens.sum():
            return lens, np.zeros((0, len(model.bias)))
        words, code = distinct([w for p in part for w in p])
        order, active = time_major(lens[lens > 0])
        p, _, _ = forward_backward(model.emissions(words)[code[order]], model.transitions, active)
        out = np.empty_like(p)
        out[order] = p
        return lens, out

    part: list[list[bytes]] = []
    size = 0
    for t in texts:
        part.append(text_words(t))
        size += len(t or "")
        if size >= STEP_BYTES:
            yield run(part)
            part, size = [], 0
    if part:
        yield run(part)


def by_text(lens: np.ndarray, values: np.ndarray, how=np.add) -> np.ndarray:
    """Sums (or maxima) of the rows of ``values`` by text; 0 for texts without words."""
    out = np.zeros((len(lens), *values.shape[1:]))
    full = np.flatnonzero(lens)
    if len(full):
        out[full] = how.reduceat(values, (np.cumsum(lens) - lens)[full], axis=0)
    return out
