"""Character-level bidirectional LSTM with CRF transitions, in numpy: inference kernels shared by training and tagging."""

from __future__ import annotations

import ctypes
import glob
import os
import unicodedata

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "person_name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N_LABELS = len(LABELS)
#: Folded characters with an id of their own; every other one is OTHER. 0 is padding.
ALPHABET = "\n" + "".join(chr(c) for c in range(32, 127))
OTHER = len(ALPHABET) + 1
VOCAB = len(ALPHABET) + 2
#: Texts of at most WINDOW folded characters are one window; longer ones are cut into windows that overlap by OVERLAP.
WINDOW, OVERLAP = 320, 96
ZERO_WIDTH = frozenset("\u200b\u200c\u200d\u2060\ufeff")


class _CharIds(dict):
    """Code point -> id of its folded character, 0 where it is dropped (marks, zero-width characters)."""

    def __missing__(self, cp: int) -> int:
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[0]
        if ch in ZERO_WIDTH or unicodedata.combining(base):
            got = 0
        else:
            base = {"đ": "d", "Đ": "D"}.get(base, base)
            if base in "\r\x0b\x0c\x85\u2028\u2029":
                base = "\n"
            elif base != "\n" and base.isspace():
                base = " "
            got = ALPHABET.find(base) + 1 or OTHER
        self[cp] = got
        return got


CHAR_IDS = _CharIds()


#: Ids by code point, filled as code points occur; -1 where not yet known.
_ID_TABLE = np.full(0x110000, -1, dtype=np.int16)


def encode_all(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids of each folded text and, for each id, its code point offset in the stored text."""
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ids = _ID_TABLE[cps]
    if len(new := np.unique(cps[ids < 0])):
        _ID_TABLE[new] = [CHAR_IDS[int(c)] for c in new]
        ids = _ID_TABLE[cps]
    at = np.flatnonzero(ids)
    ends = np.cumsum([len(t) for t in texts])
    cuts = np.searchsorted(at, ends)
    kept, out, a, start = ids[at], [], 0, 0
    for b, end in zip(cuts, ends):
        out.append((kept[a:b], at[a:b] - start))
        a, start = b, end
    return out


def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    return encode_all([text])[0]


def cut(n: int) -> list[tuple[int, int, int, int]]:
    """Windows over n characters as (start, end, first kept, end of kept): each character is kept from the window where it has most context."""
    if n <= WINDOW:
        return [(0, n, 0, n)] if n else []
    step, out, s = WINDOW - OVERLAP, [], 0
    while True:
        e = min(n, s + WINDOW)
        out.append((s, e, s + OVERLAP // 2 if s else 0, n if e == n else e - OVERLAP // 2))
        if e == n:
            return out
        s += step


def pad_windows(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Stacked ids for both reading directions, shape (2, windows, longest), and the lengths."""
    lens = np.array([len(p) for p in parts])
    ids = np.zeros((2, len(parts), int(lens.max())), dtype=np.int16)
    for k, p in enumerate(parts):
        ids[0, k, : len(p)] = p
        ids[1, k, : len(p)] = p[::-1]
    return ids, lens


def allowed() -> np.ndarray:
    """0 where label j may follow label i, else a large negative score."""
    bad = np.zeros((N_LABELS, N_LABELS), dtype=np.float32)
    for j, lab in enumerate(LABELS):
        if lab[0] == "I":
            for i, prev in enumerate(LABELS):
                if prev not in (lab, "B" + lab[1:]):
                    bad[i, j] = -1e4
    return bad


def one_thread() -> None:
    """Keeps the linear algebra library to one thread: the products here are small, and tasks run side by side."""
    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)


class Tagger:
    """Weights and batched inference. `emissions` runs both directions at once, one numpy step per character of the longest window."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, dtype=np.float32) for k, v in w.items()}
        h = self.hidden
        half = np.ones(4 * h, dtype=np.float32)
        half[: 3 * h] = 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2, so tanh serves all four gates
        table = (np.einsum("ve,deh->dvh", self.w["emb"], self.w["wx"]) + self.w["b"][:, None, :]) * half
        # the state is kept doubled, which spares halving the output gate; the sigmoid gates and the new content lie apart, so that each is one contiguous block
        wh, self.wo = self.w["wh"] * half * 0.5, self.w["wo"] * 0.5
        self.gate_table, self.new_table = np.ascontiguousarray(table[:, :, : 3 * h]), np.ascontiguousarray(table[:, :, 3 * h :])
        self.gate_wh, self.new_wh = np.ascontiguousarray(wh[:, :, : 3 * h]), np.ascontiguousarray(wh[:, :, 3 * h :])
        self.trans = self.w["trans"] + allowed()

    @property
    def hidden(self) -> int:
        return self.w["wh"].shape[1]

    @classmethod
    def load(cls, path: str | None = None) -> Tagger:
        one_thread()
        with np.load(path or os.path.join(os.path.dirname(__file__), "pii_weights.npz")) as z:
            return cls({k: z[k] for k in z.files})

    def emissions(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Label scores (length x labels) of each window; windows should be sorted by length so that little padding is computed."""
        ids, lens = pad_windows(parts)
        n, steps, h_n = len(parts), ids.shape[2], self.hidden
        order = ids.transpose(0, 2, 1).astype(np.intp)
        h, c, u, more_u = (np.zeros((2, n, h_n), dtype=np.float32) for _ in range(4))
        z, more_z = np.empty((2, n, 3 * h_n), np.float32), np.empty((2, n, 3 * h_n), np.float32)
        out = np.empty((2, steps, n, h_n), dtype=np.float32)
        i, f, o = z[:, :, :h_n], z[:, :, h_n : 2 * h_n], z[:, :, 2 * h_n :]
        for t in range(steps):
            for d in (0, 1):
                np.take(self.gate_table[d], order[d, t], axis=0, out=z[d], mode="clip")
                np.take(self.new_table[d], order[d, t], axis=0, out=u[d], mode="clip")
            z += np.matmul(h, self.gate_wh, out=more_z)
            u += np.matmul(h, self.new_wh, out=more_u)
            np.tanh(z, out=z)
            np.tanh(u, out=u)
            z += 1.0
            c *= f
            u *= i
            c += u
            c *= 0.5
            np.tanh(c, out=h)
            h *= o
            out[:, t] = h
        fwd = out[0].reshape(-1, h_n) @ self.wo[:h_n]
        fwd += self.w["bo"]
        bwd = (out[1].reshape(-1, h_n) @ self.wo[h_n:]).reshape(steps, n, N_LABELS)
        fwd = fwd.reshape(steps, n, N_LABELS)
        return [fwd[:m, k] + bwd[:m, k][::-1] for k, m in enumerate(lens)]

    def viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best label path of each text over all of its characters. Forward only the scores are kept; the way back asks for the best predecessor of the labels on the path."""
        order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
        lens = np.array([len(scores[k]) for k in order])
        steps = int(lens[0])
        em = np.zeros((len(order), steps, N_LABELS), dtype=np.float32)
        for r, k in enumerate(order):
            em[r, : lens[r]] = scores[k]
        best = np.ascontiguousarray(em.transpose(1, 2, 0))  # (steps, labels, texts), turned into the best score of a path that ends there
        live = np.searchsorted(-lens, -np.arange(steps), side="left")  # texts longer than t come first
        inner = np.array([k for k, x in enumerate(LABELS) if x[0] == "I"])
        outer = np.array([k for k, x in enumerate(LABELS) if x[0] != "I"])
        into = np.ascontiguousarray(self.trans[:, outer])[:, :, None]
        begun, kept = self.trans[inner - 1, inner][:, None], self.trans[inner, inner][:, None]
        best[0] += (self.w["start"] + np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS], dtype=np.float32))[:, None]
        for t in range(1, steps):
            m = live[t]
            p = best[t - 1, :, :m]
            best[t, outer, :m] += (p[:, None, :] + into).max(axis=0)
            best[t, inner, :m] += np.maximum(p[inner - 1] + begun, p[inner] + kept)
        ends = best[lens - 1, :, np.arange(len(order))] + self.w["end"]
        now = ends.argmax(axis=1)
        path = np.zeros((steps, len(order)), dtype=np.int8)
        backward = np.ascontiguousarray(self.trans.T)
        for t in range(steps - 1, -1, -1):
            m = live[t]
            path[t, :m] = now[:m]
            if t:
                now[:m] = (best[t - 1, :, :m].T + backward[now[:m]]).argmax(axis=1)
        paths = [np.zeros(0, np.int8)] * len(order)
        for r, k in enumerate(order):
            paths[k] = path[: lens[r], r]
        return paths

    def tag(self, texts: list[str], rows: int = 384, chars: int = 400_000) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each text, as code point offsets. Windows of all texts are run sorted by length, so many rows at a time; each text is then decoded once over
        its whole length from the reconciled window scores."""
        enc = encode_all(texts)
        wins = [(k, *w) for k, (ids, _) in enumerate(enc) for w in cut(len(ids))]
        wins.sort(key=lambda w: w[2] - w[1])
        scores = [np.empty((len(ids), N_LABELS), dtype=np.float32) for ids, _ in enc]
        for i in range(0, len(wins), rows):
            some = wins[i : i + rows]
            for (k, s, _, a, b), em in zip(some, self.emissions([enc[k][0][s:e] for k, s, e, _, _ in some])):
                scores[k][a:b] = em[a - s : b - s]
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        todo = sorted((k for k in range(len(texts)) if len(scores[k])), key=lambda k: len(scores[k]))
        i = 0
        while i < len(todo):
            j = i
            while j < len(todo) and j - i < 2 * rows and (j - i + 1) * len(scores[todo[j]]) <= chars:
                j += 1
            j = max(j, i + 1)
            for k, path in zip(todo[i:j], self.viterbi([scores[k] for k in todo[i:j]])):
                out[k] = spans(path, enc[k][1])
            i = j
        return out


def spans(path: np.ndarray, at: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of one B label and its I labels as (kind, start, end)."""
    hot = np.flatnonzero(path)
    got: list[tuple[str, int, int]] = []
    for p in hot:
        lab = LABELS[path[p]]
        if lab[0] == "B" or not got or got[-1][0] != lab[2:] or got[-1][2] != p:
            got.append((lab[2:], int(p), int(p) + 1))
        else:
            got[-1] = (got[-1][0], got[-1][1], int(p) + 1)
    return [(k, int(at[s]), int(at[e - 1]) + 1) for k, s, e in got]
