"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word's vector is a hashed word embedding next to the two final states of a
bidirectional gated network over its characters. A second bidirectional network runs
over the words of a window; attention pools its states, and a linear layer gives the
logit of the window.
"""
import zlib

import numpy as np

WORD_BUCKETS, WORD_DIM = 8192, 8
CHAR_BUCKETS, CHAR_DIM, CHAR_STATE = 512, 8, 8
STATE = 8
# words of a window, windows start this many words apart, characters per word piece
WINDOW, STRIDE, PIECE = 32, 16, 24
PAD = ""


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of a text as they stand; a longer one is cut into pieces."""
    words = (text or "").lower().split()
    if words and max(map(len, words)) > PIECE:
        words = [w[i:i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def bare(word: str) -> str:
    """The word without punctuation around it, unless it is nothing else."""
    return word.strip(".,;:!?\"'()[]{}<>«»¡¿|*_#%-") or word


def window_starts(n: int) -> range:
    """Starts of overlapping windows that cover all of n words."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def new_params(seed: int) -> dict:
    rng = np.random.default_rng(seed)
    shape = {"word": (WORD_BUCKETS, WORD_DIM), "char": (CHAR_BUCKETS, CHAR_DIM)}
    for side in "fb":
        shape |= {f"c{side}_w": (CHAR_DIM, 3 * CHAR_STATE), f"c{side}_u": (CHAR_STATE, 3 * CHAR_STATE), f"c{side}_b": (3 * CHAR_STATE,),
                  f"s{side}_w": (WORD_DIM + 2 * CHAR_STATE, 3 * STATE), f"s{side}_u": (STATE, 3 * STATE), f"s{side}_b": (3 * STATE,)}
    shape |= {"att_w": (2 * STATE, STATE), "att_b": (STATE,), "att_v": (STATE,), "out_w": (2 * STATE,), "out_b": (1,)}
    params = {k: np.zeros(s, dtype=np.float32) if k.endswith("_b") else (rng.standard_normal(s) * (0.3 if len(s) == 1 or s[0] > 100 else s[0] ** -0.5)).astype(np.float32)
              for k, s in shape.items()}
    return params


def forward_gru(gates: np.ndarray, u: np.ndarray, keep: np.ndarray | None = None, trace: list | None = None) -> np.ndarray:
    """States (time, rows, size) for input gates (time, rows, 3 x size); where ``keep`` is 0 the state stays."""
    steps, rows, size = gates.shape[0], gates.shape[1], u.shape[0]
    h, out = np.zeros((rows, size), dtype=np.float32), np.empty((steps, rows, size), dtype=np.float32)
    for t in range(steps):
        hu = h @ u
        zr = _sigmoid(gates[t, :, :2 * size] + hu[:, :2 * size])
        z, r = zr[:, :size], zr[:, size:]
        c = np.tanh(gates[t, :, 2 * size:] + r * hu[:, 2 * size:])
        new = c + z * (h - c)
        if keep is not None:
            new = h + keep[t, :, None] * (new - h)
        if trace is not None:
            trace.append((h, z, r, c, hu[:, 2 * size:]))
        h = out[t] = new
    return out


def backward_gru(grad: np.ndarray, u: np.ndarray, trace: list, keep: np.ndarray | None = None):
    """Gradients of the input gates and of u, from gradients of all states."""
    steps, rows, size = grad.shape
    d_gates, d_u, carried = np.empty((steps, rows, 3 * size), dtype=np.float32), np.zeros_like(u), np.zeros((rows, size), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, hc = trace[t]
        d = grad[t] + carried
        stay = 0.0
        if keep is not None:
            k = keep[t, :, None]
            stay, d = d * (1 - k), d * k
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (h - c) * z * (1 - z)
        dr = dc * hc * r * (1 - r)
        d_gates[t] = np.concatenate([dz, dr, dc], axis=1)
        d_hu = np.concatenate([dz, dr, dc * r], axis=1)
        d_u += h.T @ d_hu
        carried = d * z + d_hu @ u.T + stay
    return d_gates, d_u


def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % (WORD_BUCKETS - 1) + 1


def word_inputs(words: list[str], common: np.ndarray):
    """Word buckets (0 unless ``common``), character buckets (length, words) and mask of a list of words."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    keep = np.arange(max(1, sizes.max())) < sizes[:, None]
    chars = np.zeros(keep.shape, dtype=np.int64)
    chars[keep] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % (CHAR_BUCKETS - 1) + 1
    buckets = np.fromiter(map(word_bucket, words), dtype=np.int64, count=len(words))
    return np.where(common[buckets], buckets, 0), np.ascontiguousarray(chars.T), np.ascontiguousarray(keep.T.astype(np.float32))


def word_vectors(p: dict, inputs, trace: dict | None = None) -> np.ndarray:
    buckets, chars, keep = inputs
    same_length = bool(keep.all())
    ends = []
    for side in "fb":
        at, k = (chars, keep) if side == "f" else (chars[::-1], keep[::-1])
        kept: list = []
        gates = (p["char"] @ p[f"c{side}_w"] + p[f"c{side}_b"])[at]
        ends.append(forward_gru(gates, p[f"c{side}_u"], None if same_length else k, kept if trace is not None else None)[-1])
        if trace is not None:
            trace[side] = (at, None if same_length else k, kept)
    return np.concatenate([p["word"][buckets], *ends], axis=1)


def window_logits(p: dict, gates_f: np.ndarray, gates_b: np.ndarray, at: np.ndarray, real: np.ndarray, trace: dict | None = None) -> np.ndarray:
    """Logits of windows: ``at`` (time, windows) are rows of the gate tables, ``real`` marks words that are not padding."""
    states = []
    for side, table, order in (("f", gates_f, at), ("b", gates_b, at[::-1])):
        kept: list = []
        h = forward_gru(table[order], p[f"s{side}_u"], None, kept if trace is not None else None)
        states.append(h if side == "f" else h[::-1])
        if trace is not None:
            trace[side] = kept
    h = np.concatenate(states, axis=2)
    hidden = np.tanh(h @ p["att_w"] + p["att_b"])
    score = np.where(real, hidden @ p["att_v"], -1e9)
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnd->nd", weight, h)
    if trace is not None:
        trace["att"] = (h, hidden, weight, pooled)
    return pooled @ p["out_w"] + p["out_b"][0]


def gradients(p: dict, windows: list[list[str]], labels: np.ndarray, common: np.ndarray) -> tuple[float, dict]:
    """Logistic loss of a batch of windows and the gradient of every parameter."""
    vocab: dict = {PAD: 0}
    at, real = np.zeros((WINDOW, len(windows)), dtype=np.int64), np.zeros((WINDOW, len(windows)), dtype=bool)
    for j, words in enumerate(windows):
        ids = [vocab.setdefault(w, len(vocab)) for w in words]
        at[:len(ids), j], real[:len(ids), j] = ids, True
    inputs, chars_trace, trace, g = word_inputs(list(vocab), common), {}, {}, {}
    x = word_vectors(p, inputs, chars_trace)
    logits = window_logits(p, x @ p["sf_w"] + p["sf_b"], x @ p["sb_w"] + p["sb_b"], at, real, trace)
    prob = _sigmoid(logits)
    loss = float(-(labels * np.log(prob + 1e-7) + (1 - labels) * np.log(1 - prob + 1e-7)).mean())
    d = ((prob - labels) / len(labels)).astype(np.float32)
    h, hidden, weight, pooled = trace["att"]
    g["out_w"], g["out_b"] = pooled.T @ d, np.array([d.sum()], dtype=np.float32)
    d_pooled = d[:, None] * p["out_w"]
    d_weight = np.einsum("tnd,nd->tn", h, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_hidden = d_score[:, :, None] * p["att_v"] * (1 - hidden * hidden)
    g["att_v"] = np.einsum("tn,tnd->d", d_score, hidden)
    g["att_w"], g["att_b"] = np.einsum("tni,tnj->ij", h, d_hidden), d_hidden.sum(axis=(0, 1))
    d_h = weight[:, :, None] * d_pooled + d_hidden @ p["att_w"].T
    d_x = np.zeros_like(x)
    for side, part, order in (("f", d_h[:, :, :STATE], at), ("b", d_h[::-1, :, STATE:], at[::-1])):
        d_gates, g[f"s{side}_u"] = backward_gru(part, p[f"s{side}_u"], trace[side])
        d_table = np.zeros((len(x), 3 * STATE), dtype=np.float32)
        np.add.at(d_table, order.ravel(), d_gates.reshape(-1, 3 * STATE))
        g[f"s{side}_w"], g[f"s{side}_b"] = x.T @ d_table, d_table.sum(axis=0)
        d_x += d_table @ p[f"s{side}_w"].T
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], inputs[0], d_x[:, :WORD_DIM])
    for side, lo in (("f", WORD_DIM), ("b", WORD_DIM + CHAR_STATE)):
        order, keep, kept = chars_trace[side]
        grad = np.zeros((*order.shape, CHAR_STATE), dtype=np.float32)
        grad[-1] = d_x[:, lo:lo + CHAR_STATE]
        d_gates, g[f"c{side}_u"] = backward_gru(grad, p[f"c{side}_u"], kept, keep)
        d_table = np.zeros((CHAR_BUCKETS, 3 * CHAR_STATE), dtype=np.float32)
        np.add.at(d_table, order.ravel(), d_gates.reshape(-1, 3 * CHAR_STATE))
        g[f"c{side}_w"], g[f"c{side}_b"] = p["char"].T @ d_table, d_table.sum(axis=0)
        g["char"] += d_table @ p[f"c{side}_w"].T
    return loss, g


class Adam:
    """Adam steps over a dict of parameters, with the norm of a step's gradient bounded."""

    def __init__(self, params: dict, rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, g: dict):
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-12))
        rate = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, x in g.items():
            x = x * scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


class Scorer:
    """Largest window logit of texts. Gates of words are kept in a table of bounded size."""

    WORDS, BLOCK = 150_000, 2048

    def __init__(self, params: dict, common: np.ndarray):
        self.p, self.common = params, common
        self.forget()

    def forget(self):
        self.known: dict = {}
        self.gates_f = np.empty((4096, 3 * STATE), dtype=np.float32)
        self.gates_b = np.empty((4096, 3 * STATE), dtype=np.float32)
        self._learn([PAD])

    def _learn(self, words: list[str]):
        first = len(self.known)
        shown = [bare(w) for w in words]
        for i, w in enumerate(words):
            self.known[w] = first + i
        while len(self.known) > len(self.gates_f):
            self.gates_f, self.gates_b = (np.concatenate([g, np.empty_like(g)]) for g in (self.gates_f, self.gates_b))
        by_length: dict = {}
        for i, w in enumerate(shown):
            by_length.setdefault(len(w), []).append(i)
        for rows in by_length.values():
            for a in range(0, len(rows), 4 * self.BLOCK):
                part = rows[a:a + 4 * self.BLOCK]
                x = word_vectors(self.p, word_inputs([shown[i] for i in part], self.common))
                at = first + np.array(part)
                self.gates_f[at] = x @ self.p["sf_w"] + self.p["sf_b"]
                self.gates_b[at] = x @ self.p["sb_w"] + self.p["sb_b"]

    def windows(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all overlapping windows of the texts, and the text each belongs to."""
        lists = [words_of(t) for t in texts]
        every = set().union(*lists)
        new = every - self.known.keys()
        if len(self.known) + len(new) > self.WORDS and len(self.known) > 1:
            self.forget()
            new = every
        if new:
            self._learn(sorted(new))
        at, owner, get = [], [], self.known.__getitem__
        for j, words in enumerate(lists):
            if words:
                starts = window_starts(len(words))
                ids = np.zeros(starts[-1] + WINDOW, dtype=np.int32)
                ids[:len(words)] = list(map(get, words))
                at.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[::STRIDE])
                owner.append(np.full(len(starts), j))
        if not at:
            return np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.int64)
        at, owner = np.concatenate(at), np.concatenate(owner)
        logits = np.empty(len(at), dtype=np.float32)
        for a in range(0, len(at), self.BLOCK):
            part = np.ascontiguousarray(at[a:a + self.BLOCK].T)
            logits[a:a + self.BLOCK] = window_logits(self.p, self.gates_f, self.gates_b, part, part > 0)
        return logits, owner

    def texts(self, texts: list) -> np.ndarray:
        """Largest window logit of each text; minus infinity for one without words."""
        logits, owner = self.windows(texts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, owner, logits)
        return out
