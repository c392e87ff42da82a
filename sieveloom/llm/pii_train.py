"""Training of the personal-information tagger: labelled spans, back-propagation and CRF gradients in numpy.

    python -m sieveloom.llm.pii_train DIR [OUT [MINUTES [START]]]

Labelled spans come from two sources: sentence carriers ("goi PHONE hoac PHONE", "giao toi ADDRESS") found in at most MAX_ROWS messages of DIR, drawn by hash from both tables, and MADE sentences of
pii_synth, whose labels are exact. Carriers and made sentences serve here only, to label: tagging uses the network alone.
"""

from __future__ import annotations

import multiprocessing
import re
import sys
import time

import numpy as np

from sieveloom.llm.pii_model import ALPHABET, KINDS, LABELS, N_LABELS, OTHER, VOCAB, Tagger, allowed, cut, encode, encode_all, pad_windows

#: Bound of the labelled sample, and number of made sentences.
MAX_ROWS, MADE = 24_000, 60_000
HIDDEN, EMB = 40, 20

_B = r"[ \n]*"
TITLE = r"(?:ong|ba|anh|chi|co|chu|bac|em)"
PHONE = re.compile(r"(?<![\d.\-+])(?:\+?84|0)(?:[ .\-]?\d){9}(?![\d])")
EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+\-]*(?: ?@ ?| ?\(at\) ?| ?\[at\] ?)[A-Za-z0-9\-]+(?:(?:\.|\[dot\]| ?\(dot\) ?)[A-Za-z0-9\-]+)+", re.I)
ID = re.compile(rf"(?:cccd|cmnd|can\s+cuoc(?:\s+cong\s+dan)?|chung\s+minh(?:\s+nhan\s+dan)?|ho\s+chieu|passport)(?:/cmnd)?(?:\s+so)?\s*:?\s*([A-Z]\d{{7}}|\d(?:[ .\-]?\d){{8,11}})(?!\d)", re.I)
NAME_AT = [re.compile(p, re.I) for p in (
    r"\bchao\s+(.{2,40}?)\s*,?\s*moi\s+xem", r"\bchu\s+the\s+(.{2,40}?)\s+xac\s+nhan", r"\bnguoi\s+nhan\s+(.{2,40}?)\s*\(", r"\bkhach\s+hang\s+(.{2,40}?)\s*,\s*(?:so\s+)?(?:cccd|cmnd|can|chung|ho\s+chieu|passport)",
    r"\bho\s+so\s+cua\s+(.{2,40}?)\s+gom", r"\blien\s+he\s+(.{2,40}?)\s+qua", r"\bquan\s+ly\s+(.{2,40}?)\s*[-–]", r"\bKH\s*:\s*(.{2,40}?)\s*;\s*SDT",
)]
ADDRESS_AT = [re.compile(p, re.I | re.S) for p in (
    r"\bd/c\s*:\s*(.{6,140}?)(?=\.(?=\s|$)|\n|$)", r"\bgiao\s+toi\s+(.{6,140}?)(?=,?\s+goi\s)", r"\bban\s+giay\s+toi\s+(.{6,140}?)(?=\.(?=\s|$)|\n|$)", r"\bben\s+em\s+ghe\s+(.{6,140}?)(?=\s+luc\s)",
)]
_HOUSE = re.compile(r"^(?:so\s+nha|so|can\s+ho|phong|P\.?)?\s*(\d)", re.I)


def label(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels of one folded text and the number of its spans."""
    text = "".join(ALPHABET[i - 1] if i != OTHER else "\x7f" for i in ids)
    y = np.zeros(len(text), dtype=np.int8)
    found: list[tuple[str, int, int]] = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("id_number", *m.span(1)) for m in ID.finditer(text)]
    found += [("phone", *m.span()) for m in PHONE.finditer(text)]
    for pat in ADDRESS_AT:
        for m in pat.finditer(text):
            if h := _HOUSE.match(m.group(1)):
                s, e = m.start(1) + h.start(1), m.end(1)
                found.append(("address", s, e))
    for pat in NAME_AT:
        for m in pat.finditer(text):
            s, e = m.span(1)
            words = text[s:e].split()
            if (t := re.match(rf"{TITLE}\s+", text[s:e], re.I)) and not (text[s : s + 3] in ("Chu", "CHU") and (len(words) > 1)):
                s += t.end()
            if e > s and re.fullmatch(r"[A-Za-z]+(?:\s+[A-Za-z]+){0,4}", text[s:e]):
                found.append(("person_name", s, e))
    n = 0
    for kind, s, e in found:
        if not y[s:e].any():
            b = LABELS.index(f"B-{kind}")
            y[s] = b
            y[s + 1 : e] = b + 1
            n += 1
    return y, n


def label_spans(at: np.ndarray, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Labels of a folded text whose characters stand at the offsets `at`, from (kind, start, end)."""
    y = np.zeros(len(at), dtype=np.int8)
    for kind, a, b in spans:
        s, e = np.searchsorted(at, [a, b])
        if e > s:
            y[s] = LABELS.index(f"B-{kind}")
            y[s + 1 : e] = y[s] + 1
    return y


def _crf_grad(em: np.ndarray, y: np.ndarray, lens: np.ndarray, w: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Negative log-likelihood and its gradients. em: (steps, windows, labels)."""
    steps, n, k = em.shape
    trans = w["trans"] + bad
    live = np.arange(steps)[:, None] < lens
    rows = np.arange(n)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    alpha, beta = np.empty_like(em), np.empty_like(em)
    alpha[0] = em[0] + w["start"]
    for t in range(1, steps):
        alpha[t] = np.where(live[t][:, None], lse(alpha[t - 1][:, :, None] + trans, 1) + em[t], alpha[t - 1])
    logz = lse(alpha[-1] + w["end"], 1)
    beta[-1] = w["end"]
    for t in range(steps - 2, -1, -1):
        beta[t] = np.where(live[t + 1][:, None], lse(trans[None] + (em[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
    g_em = np.exp(alpha + beta - logz[None, :, None]) * live[:, :, None]
    g_start, g_end = g_em[0].sum(0), g_em[lens - 1, rows].sum(0)
    g_trans = np.zeros_like(w["trans"])
    for t in range(1, steps):
        p = np.exp(alpha[t - 1][:, :, None] + trans + (em[t] + beta[t])[:, None, :] - logz[:, None, None])
        g_trans += (p * live[t][:, None, None]).sum(0)
    tt, bb = np.nonzero(live)
    gold = em[tt, bb, y[tt, bb]].sum() + w["start"][y[0]].sum() + w["end"][y[lens - 1, rows]].sum()
    g_em[tt, bb, y[tt, bb]] -= 1
    np.add.at(g_start, y[0], -1)
    np.add.at(g_end, y[lens - 1, rows], -1)
    t2, b2 = np.nonzero(live[1:])
    prev, cur = y[t2, b2], y[t2 + 1, b2]
    gold += trans[prev, cur].sum()
    np.add.at(g_trans, (prev, cur), -1)
    return float(logz.sum() - gold), g_em, g_trans, g_start, g_end


def gradients(w: dict[str, np.ndarray], parts: list[np.ndarray], ys: list[np.ndarray], bad: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    ids, lens = pad_windows(parts)
    n, steps, h_n = len(parts), ids.shape[2], w["wh"].shape[1]
    table = np.einsum("ve,deh->dvh", w["emb"], w["wx"]) + w["b"][:, None, :]
    both = np.arange(2)[:, None]
    h = np.zeros((2, n, h_n), np.float32)
    c = np.zeros_like(h)
    hs, cs = [h], [c]
    gates = np.empty((steps, 2, n, 4 * h_n), np.float32)
    for t in range(steps):
        z = np.matmul(h, w["wh"]) + table[both, ids[:, :, t]]
        z[:, :, : 3 * h_n] = 1 / (1 + np.exp(-z[:, :, : 3 * h_n]))
        z[:, :, 3 * h_n :] = np.tanh(z[:, :, 3 * h_n :])
        gates[t] = z
        c = c * z[:, :, h_n : 2 * h_n] + z[:, :, :h_n] * z[:, :, 3 * h_n :]
        h = z[:, :, 2 * h_n : 3 * h_n] * np.tanh(c)
        hs.append(h)
        cs.append(c)
    out = np.stack(hs[1:])  # (steps, 2, n, h)
    turn = lens[None, :] - 1 - np.arange(steps)[:, None]  # where a position lies in the reversed reading
    turn = np.where(turn >= 0, turn, np.arange(steps)[:, None])
    cols = np.arange(n)[None, :]
    feats = np.concatenate([out[:, 0], out[:, 1][turn, cols]], axis=2)
    em = feats @ w["wo"] + w["bo"]
    y = np.zeros((steps, n), np.int64)
    for k, v in enumerate(ys):
        y[: len(v), k] = v
    loss, g_em, g_trans, g_start, g_end = _crf_grad(em, y, lens, w, bad)
    g_em = g_em.astype(np.float32)
    g = {"trans": g_trans, "start": g_start, "end": g_end, "bo": g_em.sum((0, 1)), "wo": np.einsum("tnf,tnk->fk", feats, g_em, optimize=True)}
    d_feats = g_em @ w["wo"].T
    d_out = np.zeros_like(out)
    d_out[:, 0] = d_feats[:, :, :h_n]
    d_out[:, 1][turn, cols] = d_feats[:, :, h_n:]
    d_out *= (np.arange(steps)[:, None] < lens)[:, None, :, None]
    dz = np.empty_like(gates)
    dh, dc = np.zeros_like(h), np.zeros_like(h)
    wht = w["wh"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        i, f, o, u = (gates[t][:, :, j * h_n : (j + 1) * h_n] for j in range(4))
        dh = dh + d_out[t]
        tc = np.tanh(cs[t + 1])
        dc = dc + dh * o * (1 - tc * tc)
        dz[t][:, :, :h_n] = dc * u * i * (1 - i)
        dz[t][:, :, h_n : 2 * h_n] = dc * cs[t] * f * (1 - f)
        dz[t][:, :, 2 * h_n : 3 * h_n] = dh * tc * o * (1 - o)
        dz[t][:, :, 3 * h_n :] = dc * i * (1 - u * u)
        dh = np.matmul(dz[t], wht)
        dc = dc * f
    g["wh"] = np.stack([np.einsum("tnh,tng->hg", np.stack([x[d] for x in hs[:-1]]), dz[:, d], optimize=True) for d in (0, 1)])
    d_table = np.zeros_like(table)
    for d in (0, 1):
        flat, rows = ids[d].T.reshape(-1), dz[:, d].reshape(-1, 4 * h_n)
        hot = np.zeros((len(flat), VOCAB), np.float32)
        hot[np.arange(len(flat)), flat] = 1
        d_table[d] = hot.T @ rows
    g["b"] = d_table.sum(1)
    g["wx"] = np.einsum("ve,dvh->deh", w["emb"], d_table)
    g["emb"] = np.einsum("dvh,deh->ve", d_table, w["wx"])
    return loss, g


def _share(job: tuple) -> tuple[float, dict[str, np.ndarray]]:
    w, parts, ys = job
    return gradients(w, parts, ys, allowed())


_LOWER = np.arange(VOCAB)
_LOWER[[ALPHABET.index(c) + 1 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = [ALPHABET.index(c) + 1 for c in "abcdefghijklmnopqrstuvwxyz"]


def disturbed(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A window with some characters unknown and, in one of four, its names (in one of ten, all of it) in lower case, as careless writers have them."""
    x = np.where(rng.random(len(x)) < 0.02, OTHER, x)
    u = rng.random()
    return _LOWER[x] if u < 0.1 else np.where(y >= LABELS.index("B-person_name"), _LOWER[x], x) if u < 0.35 else x


def labelled(texts: list[str], made: list[tuple[str, list[tuple[str, int, int]]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows (ids, labels) of messages, labelled by carriers, and of made sentences."""
    rows = []
    for ids, _ in encode_all(texts):
        rows.append((ids, label(ids)[0]))
    for (ids, at), (_, spans) in zip(encode_all([t for t, _ in made]), made):
        rows.append((ids, label_spans(at, spans)))
    return [(ids[s:e], y[s:e]) for ids, y in rows for s, e, _, _ in cut(len(ids))]


def fit(
    texts: list[str], made: list[tuple[str, list[tuple[str, int, int]]]] = (), minutes: float = 10.0, seed: int = 7, batch: int = 24, workers: int = 8, start: dict[str, np.ndarray] | None = None, peak: float = 5e-3, log=print,
) -> dict[str, np.ndarray]:
    """Weights after Adam over windows of the labelled texts for the given time, from random ones or from `start`; each step sums the gradients of one batch a worker process."""
    rng = np.random.default_rng(seed)
    windows = labelled(texts, list(made))
    windows.sort(key=lambda x: len(x[0]))
    batches = [windows[i : i + batch] for i in range(0, len(windows), batch)]
    w = {
        "emb": rng.normal(0, 0.3, (VOCAB, EMB)), "wx": rng.normal(0, EMB**-0.5, (2, EMB, 4 * HIDDEN)), "wh": rng.normal(0, HIDDEN**-0.5, (2, HIDDEN, 4 * HIDDEN)), "b": np.zeros((2, 4 * HIDDEN)),
        "wo": rng.normal(0, (2 * HIDDEN) ** -0.5, (2 * HIDDEN, N_LABELS)), "bo": np.zeros(N_LABELS), "trans": np.zeros((N_LABELS, N_LABELS)), "start": np.zeros(N_LABELS), "end": np.zeros(N_LABELS),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    w["b"][:, HIDDEN : 2 * HIDDEN] = 1.0
    if start is not None:
        w = {k: np.array(start[k], dtype=np.float32) for k in w}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    began, step, epoch = time.time(), 0, 0
    pool = multiprocessing.get_context("fork").Pool(workers)
    while time.time() - began < 60 * minutes:
        total, chars = 0.0, 0
        for at in rng.permutation(len(batches) // workers + 1) * workers:  # batches of like lengths are done side by side
            done = (time.time() - began) / (60 * minutes)
            if done >= 1:
                break
            rate = peak * (1 - done) + 1e-4
            jobs = [(w, [disturbed(x, y, rng) for x, y in batches[b]], [y for _, y in batches[b]]) for b in range(at, min(at + workers, len(batches)))]
            if not jobs:
                continue
            got = pool.map(_share, jobs, chunksize=1)
            rows = sum(len(j[1]) for j in jobs)
            g = {k: sum(x[1][k] for x in got) for k in w}
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values())) / rows
            clip = min(1.0, 5.0 / max(norm, 1e-9)) / rows
            for k in w:
                gk = (g[k] * clip).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * gk
                v2[k] = 0.99 * v2[k] + 0.01 * gk * gk
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
            total += sum(x[0] for x in got)
            chars += sum(len(p) for j in jobs for p in j[1])
        epoch += 1
        log(f"epoch {epoch}: loss a character {total / max(1, chars):.5f}, {time.time() - began:.0f} s", flush=True)
    pool.terminate()
    return w


def evaluate(tagger: Tagger, texts: list[str]) -> dict[str, tuple[int, int, int]]:
    """(hits, missed, extra) by kind; a hit has the same kind and start."""
    out = {k: [0, 0, 0] for k in KINDS}
    for t, got in zip(texts, tagger.tag(texts)):
        ids, at = encode(t)
        y, _ = label(ids)
        gold = {(LABELS[y[p]][2:], int(at[p])) for p in np.flatnonzero(y) if LABELS[y[p]][0] == "B"}
        mine = {(k, s) for k, s, _ in got}
        for k, hit in [(k, 0) for k, _ in gold & mine] + [(k, 1) for k, _ in gold - mine] + [(k, 2) for k, _ in mine - gold]:
            out[k][hit] += 1
    return {k: tuple(v) for k, v in out.items()}


def score(tagger: Tagger, rows: list[tuple[str, list[tuple[str, int, int]]]]) -> dict[str, tuple[int, int, int]]:
    """(hits, missed, extra) by kind of texts with known spans; a hit has the same kind and start."""
    out = {k: [0, 0, 0] for k in KINDS}
    for (_, spans), got in zip(rows, tagger.tag([t for t, _ in rows])):
        gold, mine = {(k, s) for k, s, _ in spans}, {(k, s) for k, s, _ in got}
        for k, hit in [(k, 0) for k, _ in gold & mine] + [(k, 1) for k, _ in gold - mine] + [(k, 2) for k, _ in mine - gold]:
            out[k][hit] += 1
    return {k: tuple(v) for k, v in out.items()}


def sample(folder: str, most: int = MAX_ROWS) -> list[str]:
    """At most `most` distinct messages of the two tables, drawn by hash from both alike."""
    import pyarrow.parquet as pq
    import xxhash

    texts = pq.read_table(f"{folder}/corpus.parquet", columns=["text"])["text"].to_pylist()
    texts += [x["input_text"] if x else None for x in pq.read_table(f"{folder}/special_case_results.parquet", columns=["result"])["result"].to_pylist()]
    return sorted({t for t in texts if t}, key=lambda t: (xxhash.xxh3_64_intdigest(t), t))[:most]


def main(argv: list[str]) -> None:
    from sieveloom.llm import pii_synth

    rows = sample(argv[0])
    words = pii_synth.vocabularies(rows)
    made = pii_synth.texts(MADE, words)
    weights = fit(rows, made, minutes=float(argv[2]) if len(argv) > 2 else 10.0, start=Tagger.load(argv[3]).w if len(argv) > 3 else None)
    out = argv[1] if len(argv) > 1 else __file__.replace("pii_train.py", "pii_weights.npz")
    np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in weights.items()})
    print("made sentences not trained on (hits, missed, extra):", score(Tagger.load(out), pii_synth.texts(2000, words, seed=99)))


if __name__ == "__main__":
    main(sys.argv[1:])
