"""Secret scan: patterns, and a linear-chain conditional random field that tags tokens as secret begin, inside or outside.

The field's features are a token's shape, its neighbours and what stands between them, and figures of the whole file. It is
trained here, on windows of a bounded sample of documents: around the patterns' hits, at other places, and around strings
that are put into copies of the sampled texts. Some of these are made as secrets are made (random characters of many alphabets,
with and without prefix, name or marks); others only look alike (addresses, dates, numbers, names of things) and stay outside.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundamentals_spark.llm import bytehash

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
#: Documents in the training sample: those lowest in hash order of their id. Windows of the sample that the fit takes at
#: most, lowest in hash order of their features. Tokens of a window. One token of so many begins a window without a hit.
SAMPLE, WINDOWS = 3000, 9000
WINDOW, OTHER_RATE = 12, 512
#: Strings put into the copy of a sampled text.
MADE = 3
HASH_BITS = 10
CHUNK = 1 << 20
KINDS = ("assign", "access", "hex")
#: The base patterns; letters of the first one's names in either case.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points by start, then kind; matches that fail their test are dropped, without a second try."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[np.frombuffer(chars, dtype=np.uint8)] = True
    return t


_UPPER, _LOW, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(bytes(range(48, 58)))
_HEXD, _MARK = _table(b"0123456789abcdef"), _table(b"+/_-.")
_HIGH = _table(bytes(range(128, 256)))
_TOKEN = _UPPER | _LOW | _DIGIT | _MARK | _HIGH
_SEPS = (_table(b"="), _table(b":"), _table(b"\"'"), _table(b"\n"))
_CLASS = np.zeros(256, dtype=np.int8)
for _i, _t in enumerate((_UPPER, _LOW, _DIGIT, _MARK, _HIGH)):
    _CLASS[_t] = _i + 1
_LOWER = bytehash.lower_table()
#: Binary features of a token by group; then hashed words before it. One column of ids for each group.
GROUPS = (8, 32, 32, 8, 16, 16, 8, 8, 8)
STARTS = np.concatenate([[0], np.cumsum(GROUPS)])
#: Two more ids: of tokens beyond the end of a short row, and of masked features, whose weights stay 0.
PAD = int(STARTS[-1]) + 2 * (1 << HASH_BITS)
MASKED = PAD + 1
N_FEATURES = MASKED + 1
#: Columns of features that tell a pattern's cue: a token's size and the two words before it.
CUES = (0, len(GROUPS), len(GROUPS) + 1)


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    feats: np.ndarray  # tokens x groups, ids of active features


def tokens_of(buf: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens and their features for all rows of a buffer at once."""
    start, end, row = bytehash.word_spans(buf, offsets, _TOKEN)
    n = len(start)
    if n == 0:
        return Tokens(start, end, row, np.zeros((0, len(GROUPS) + 2), dtype=np.int32))

    def count(table: np.ndarray) -> np.ndarray:
        c = np.zeros(len(buf) + 1, dtype=np.int32)
        np.cumsum(table[buf], out=c[1:])
        return c

    length = end - start
    inside = {k: (c := count(t))[end] - c[start] for k, t in (("u", _UPPER), ("l", _LOW), ("d", _DIGIT), ("h", _HEXD), ("m", _MARK))}
    cls = _CLASS[buf]
    turn = np.zeros(len(buf) + 1, dtype=np.int32)
    if len(buf) > 1:
        np.cumsum(cls[1:] != cls[:-1], out=turn[2:])
    turns = turn[end] - turn[start + 1]
    before = np.concatenate([[0], end[:-1]])
    before = np.where(np.concatenate([[True], row[1:] != row[:-1]]), offsets[row], before)
    seps = np.zeros(n, dtype=np.int64)
    for i, t in enumerate(_SEPS):
        c = count(t)
        seps |= (c[start] - c[before] > 0).astype(np.int64) << i
    joined = row[1:] == row[:-1]  # nothing of a token depends on another row
    seps_after = np.append(np.where(joined, seps[1:], 0), 0)
    h = bytehash.mix(bytehash.substring_hash(bytehash.prefix_hash(buf, _LOWER), start, end)) >> np.uint64(64 - HASH_BITS)
    word = np.where(row == np.append([-1], row[:-1]), np.append([0], h[:-1].astype(np.int64)), 0)
    word2 = np.where(row == np.append([-1], row[:-1]), np.append([0], word[:-1]), 0)
    per_row = np.bincount(row, minlength=len(offsets) - 1)
    digit_row = np.bincount(row, weights=inside["d"] > 0, minlength=len(offsets) - 1) / np.maximum(per_row, 1)
    sign_row = np.bincount(row, weights=seps & 3 > 0, minlength=len(offsets) - 1) / np.maximum(per_row, 1)
    size = np.minimum(7, np.log2(np.maximum(length, 1)).astype(np.int64))
    shape = (inside["u"] > 0) + 2 * (inside["l"] > 0) + 4 * (inside["d"] > 0) + 8 * (inside["m"] > 0) + 16 * (inside["h"] == length)
    turned = np.minimum(7, turns * 8 // np.maximum(length, 1)) + 8 * np.minimum(3, inside["d"] * 4 // np.maximum(length, 1))
    strong = np.minimum(7, ((length >= 16).astype(np.int64) + 2 * ((inside["d"] > 1) & (inside["u"] + inside["l"] > 1)) + 4 * (turns >= 5)))
    groups = (size, shape, turned, strong, seps, seps_after, np.append([0], np.where(joined, strong[:-1], 0)), np.minimum(7, (digit_row[row] * 16).astype(np.int64)), np.minimum(7, (sign_row[row] * 16).astype(np.int64)))
    feats = np.empty((n, len(GROUPS) + 2), dtype=np.int32)
    for g, values in enumerate(groups):
        feats[:, g] = STARTS[g] + values
    feats[:, -2] = STARTS[-1] + word
    feats[:, -1] = STARTS[-1] + (1 << HASH_BITS) + word2
    return Tokens(start, end, row, feats)


@dataclass
class Crf:
    weights: np.ndarray  # features x 3
    moves: np.ndarray  # 3 x 3

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        e = np.zeros((len(feats), 3))
        for g in range(feats.shape[1]):
            e += self.weights[feats[:, g]]
        return e

    def decode(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Most likely tags of all chains (``first``: True where a chain begins), by Viterbi.

        A token whose outside score leads by more than two moves can differ is outside in every best path, so the paths
        between such tokens are found apart from each other; the result is that of one run over the whole chain.
        """
        tags = np.full(len(e), OUTSIDE, dtype=np.int8)
        slack = 2 * (self.moves.max() - self.moves.min())
        open_ = np.flatnonzero(e[:, OUTSIDE] - np.maximum(e[:, BEGIN], e[:, INSIDE]) <= slack)
        if not len(open_):
            return tags
        cut = np.flatnonzero((np.diff(open_) > 1) | first[open_[1:]]) + 1
        start = open_[np.concatenate([[0], cut])]
        size = np.diff(np.concatenate([[0], cut, [len(open_)]]))
        order = np.argsort(-size, kind="stable")  # all paths take a step at once, the longest first
        start, size = start[order], size[order]
        live = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="left")  # paths of more than k tokens
        score = e[start] + np.where(first[start][:, None], 0.0, self.moves[OUTSIDE])  # the token before is outside
        back = np.zeros((len(e), 3), dtype=np.int8)
        for k in range(1, int(size[0])):
            m, at = live[k], start[: live[k]] + k
            come = (score[:m, :, None] + self.moves)[:, ::-1]
            best = come.argmax(axis=1)
            back[at] = 2 - best
            score[:m] = np.take_along_axis(come, best[:, None], axis=1)[:, 0] + e[at]
        end = start + size
        score += np.where((end < len(e)) & ~first[np.minimum(end, len(e) - 1)], 1.0, 0.0)[:, None] * self.moves[:, OUTSIDE]
        tag = 2 - score[:, ::-1].argmax(axis=1)
        for k in range(int(size[0]) - 1, -1, -1):
            m, at = live[k], start[: live[k]] + k
            tags[at] = tag[:m]
            tag[:m] = back[at, tag[:m]] if k else tag[:m]
        return tags


def fit_crf(feats: np.ndarray, tags: np.ndarray, steps: int = 120, l2: float = 1e-3) -> Crf:
    """Maximum likelihood on windows of equal length (windows x WINDOW x groups), forward-backward over all at once, Adam."""
    w, t = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    if not len(feats):
        w[:, OUTSIDE] = 1.0
        return Crf(w, t)
    n, size, _ = feats.shape
    flat = feats.reshape(n * size, -1)
    gold = np.eye(3)[tags]
    gold_moves = np.einsum("nsi,nsj->ij", gold[:, :-1], gold[:, 1:])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for k in range(1, steps + 1):
        e = Crf(w, t).emissions(flat).reshape(n, size, 3)
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for s in range(1, size):
            fwd[:, s] = e[:, s] + lse(fwd[:, s - 1][:, :, None] + t, 1)
        for s in range(size - 2, -1, -1):
            bwd[:, s] = lse(t + (e[:, s + 1] + bwd[:, s + 1])[:, None, :], 2)
        z = lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None])
        pairs = np.exp(fwd[:, :-1, :, None] + t + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        diff = ((p - gold) / n).reshape(n * size, 3)
        gw = np.stack([np.bincount(flat.ravel(), weights=np.repeat(diff[:, c], flat.shape[1]), minlength=N_FEATURES) for c in range(3)], axis=1) + l2 * w
        gt = (pairs - gold_moves) / n + 10 * l2 * t
        for x, g, i in ((w, gw, 0), (t, gt, 2)):
            if i == 0:
                g[MASKED] = 0.0
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.999 * state[i + 1] + 0.001 * g * g
            x -= 0.1 * (state[i] / (1 - 0.9**k)) / (np.sqrt(state[i + 1] / (1 - 0.999**k)) + 1e-8)
    return Crf(w, t)


def _char_places(raw: np.ndarray) -> np.ndarray:
    """Code points before every byte."""
    c = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=c[1:])
    return c


def _flagged(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a match: a hexadecimal run of 32, a colon or equals sign, or AKIA."""
    s, e, r = bytehash.word_spans(buf, offsets, _HEXD)
    out = np.zeros(len(offsets) - 1, dtype=bool)
    out[r[e - s >= 32]] = True
    signs = np.flatnonzero((_SEPS[0] | _SEPS[1])[buf])
    out[np.searchsorted(offsets, signs, side="right") - 1] = True
    if len(buf) >= 4:
        akia = np.flatnonzero((buf[:-3] == 65) & (buf[1:-2] == 75) & (buf[2:-1] == 73) & (buf[3:] == 65))
        out[np.searchsorted(offsets, akia, side="right") - 1] = True
    return out


def _windows(tok: Tokens, tag: np.ndarray, salt: np.ndarray, around: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows around hits and, unless places are given by ``around``, around places that a hash of (row, place in the row) picks: features and tags.

    A window stays in its row; a row with fewer tokens is padded. In every other window, by hash, the cues of the
    patterns are masked, so that the field also learns shape and what stands between tokens. What a row gives depends on
    the row alone.
    """
    none = np.zeros((0, WINDOW, len(GROUPS) + 2), dtype=np.int32), np.zeros((0, WINDOW), dtype=np.int8)
    if not len(tag):
        return none
    first = np.searchsorted(tok.row, np.arange(len(salt) + 1))
    place = np.arange(len(tag)) - first[tok.row]
    drawn = bytehash.mix(salt[tok.row] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    centre = np.flatnonzero((tag == BEGIN) | (drawn % np.uint64(OTHER_RATE) == 0) if around is None else around)
    row = tok.row[centre]
    at = np.maximum(np.minimum(centre - WINDOW // 2, first[row + 1] - WINDOW), first[row])
    at, keep = np.unique(at, return_index=True)
    if not len(at):
        return none
    row = row[keep]
    idx = at[:, None] + np.arange(WINDOW)
    inside = idx < first[row + 1][:, None]
    idx = np.minimum(idx, len(tag) - 1)
    feats = np.where(inside[:, :, None], tok.feats[idx], PAD).astype(np.int32)
    masked = (drawn[at] >> np.uint64(40)) & np.uint64(1) == 1
    for c in CUES:
        feats[:, :, c] = np.where(masked[:, None] & inside, MASKED, feats[:, :, c])
    return feats, np.where(inside, tag[idx], OUTSIDE).astype(np.int8)


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_ALPHABETS = (_ALNUM, _ALNUM + "+/", _ALNUM + "-_", "0123456789abcdef", "0123456789ABCDEF", _ALNUM[26:], _ALNUM[:26] + _ALNUM[52:])
_SIGNS = "!#$%&*@^~?"
_CALLED = ("pass", "pwd", "key", "auth", "credential", "private", "login", "cert", "signing", "access", "bearer", "admin", "db", "client", "service", "user")
_AROUND = ("{}", "{}", "{}", "({})", '"{}"', "{},", "{}.", "is {}", "with {}", "key {}", "bearer {}", '{n} = "{}"', "{n}={}", "{n}: {}", "'{n}': '{}'", "{n} {}", "--{n} {}", "{n} -> {}", "login with {} today")


def _secret(rng: np.random.Generator) -> str:
    """A random string as keys, tokens and passwords are made."""
    pick = lambda chars, n: "".join(chars[k] for k in rng.integers(0, len(chars), n))
    kind = rng.integers(0, 6)
    alphabet = _ALPHABETS[rng.integers(0, len(_ALPHABETS))]
    if kind == 0:  # sections with dots or dashes
        join = ".-_"[rng.integers(0, 3)]
        return join.join(pick(alphabet, int(rng.integers(8, 44))) for _ in range(rng.integers(2, 5)))
    if kind == 1:  # a short prefix
        return pick(_ALNUM[26:52], int(rng.integers(2, 6))) + "_-"[rng.integers(0, 2)] + pick(alphabet, int(rng.integers(16, 48)))
    if kind == 2:  # a password with marks
        return pick(_ALNUM, int(rng.integers(3, 6))) + pick(_SIGNS, 1) + pick(_ALNUM, int(rng.integers(3, 8))) + pick(_SIGNS, int(rng.integers(0, 2))) + pick(_ALNUM, int(rng.integers(3, 6)))
    return pick(alphabet, int(rng.integers(14, 32) if alphabet in _ALPHABETS[3:5] else rng.integers(12, 64)))


def _lookalike(rng: np.random.Generator, words: list[str]) -> str:
    """A string with digits, marks or mixed case that is no secret."""
    word = lambda: words[rng.integers(0, len(words))]
    n = lambda k: str(rng.integers(10 ** (k - 1), 10**k))
    return (
        lambda: f"https://{word()}.example.com/{word()}/{n(5)}?{word()}={n(2)}", lambda: f"{word()}.{word()}{n(2)}@{word()}.example", lambda: f"2{n(3)}-0{n(1)}-{n(2)}T1{n(1)}:{n(2)}:{n(2)}Z", lambda: f"+{n(2)} {n(3)} {n(4)}-{n(3)}",
        lambda: "_".join(word() for _ in range(rng.integers(2, 5))), lambda: word() + word().capitalize() + word().capitalize(), lambda: f"v{n(1)}.{n(2)}.{n(1)}-rc{n(1)}", lambda: f"{n(3)}.{n(3)},{n(2)}", lambda: " ".join(n(4) for _ in range(4)),
        lambda: f"/usr/{word()}/{word()}_{n(4)}.tar.gz", lambda: f"{n(3)}.{n(2)}.{n(3)}.{n(1)}", lambda: f"{word().upper()}-{n(4)}", lambda: n(int(rng.integers(6, 17))), lambda: f"{word()}-{word()}-{word()}", lambda: "-" * int(rng.integers(3, 40)),
        lambda: f"DE{n(2)} {n(4)} {n(4)} {n(4)} {n(4)} {n(2)}", lambda: f"{word()}({word()}[{n(1)}], {word()})", lambda: f"{word()}{n(2)}", lambda: word() * 3, lambda: f"{word()} = {word()}", lambda: f"{word()}: {n(3)}", lambda: "".join(word() for _ in range(3)).upper(),
        lambda: " ".join([word()] * int(rng.integers(4, 30))), lambda: " ".join([word().capitalize()] * int(rng.integers(4, 30))),
    )[rng.integers(0, 24)]()


def _planted(text: str, salt: int) -> tuple[str, list[tuple[int, int, bool]]]:
    """``text``, whole or a part of it, with made strings put between its words: the new text, and place and kind (true: secret) of each."""
    rng = np.random.default_rng(int(salt))
    words = [w for w in re.findall(r"[^\W\d_]{2,12}", text[:4000])] or ["a"]
    if rng.random() < 0.5:
        at = int(rng.integers(0, len(text) + 1))
        text = text[at : at + int(rng.integers(0, 500))]
    gaps = [m.start() for m in re.finditer("[ \n]", text)] or [0]
    out, spans, last, size = [], [], 0, 0
    for at in sorted({gaps[k] for k in rng.integers(0, len(gaps), MADE)}):
        secret = bool(rng.random() < 0.5)
        body = _secret(rng) if secret else _lookalike(rng, words)
        named = _CALLED[rng.integers(0, len(_CALLED))]
        named = (named, f"{words[0].lower()}_{named}", named.upper())[rng.integers(0, 3)]
        around = _AROUND[rng.integers(0, len(_AROUND) if secret else 10)].replace("{n}", named)
        before, _, after = around.partition("{}")
        piece = text[last:at] + " " + before
        spans.append((size + len(piece), size + len(piece) + len(body), secret))
        out += [piece, body, after]
        size += len(piece) + len(body) + len(after)
        last = at
    return "".join(out) + text[last:], spans


def _planted_windows(texts: list[str], salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows around the made strings of a copy of each text."""
    made = [_planted(t, s) for t, s in zip(texts, salts)]
    buf, off = bytehash.text_buffer(pa.array([m[0] for m in made], pa.large_string()))
    tok = tokens_of(buf, off)
    tag, centre = np.full(len(tok.start), OUTSIDE, dtype=np.int8), np.zeros(len(tok.start), dtype=bool)
    for r, (_, spans) in enumerate(made):
        places = _char_places(buf[off[r] : off[r + 1]])
        for a, b, secret in spans:
            lo, hi = off[r] + np.searchsorted(places, a), off[r] + np.searchsorted(places, b)
            inside = np.arange(np.searchsorted(tok.end, lo, side="right"), np.searchsorted(tok.start, hi))
            centre[inside[: 1 if secret else None : WINDOW // 2]] = True
            if secret:
                tag[inside] = INSIDE
                tag[inside[:1]] = BEGIN
    return _windows(tok, tag, salts, centre)


def train_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, windows: int = WINDOWS) -> Crf:
    """Fit on at most ``windows`` windows of at most ``sample`` documents: around tokens in pattern hits, at other places, and around made strings in copies.

    The windows depend on ids and texts alone, so partitions and batches do not change the model. Null ids are left out; rows
    that share an id all take part, and equal windows count once. Without a window every token is outside.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = docs.join(F.broadcast(ids), "doc_id").select("text", F.xxhash64("doc_id").alias("salt"))  # at most ``sample`` ids

    def run(batches):
        for batch in batches:
            buf, offsets = bytehash.text_buffer(batch.column("text"))
            salts = batch.column("salt").to_numpy().view(np.uint64)
            for i, j in bytehash.row_chunks(offsets, CHUNK):
                part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                tok = tokens_of(part, off)
                tag = np.full(len(tok.start), OUTSIDE, dtype=np.int8)
                for r in np.flatnonzero(_flagged(part, off)):
                    raw = part[off[r] : off[r + 1]]
                    places = _char_places(raw)
                    text = raw.tobytes().decode()
                    for a, kind, b in base_spans(text):
                        if kind == 0:
                            a = b - len(ASSIGN.fullmatch(text[a:b])[1])
                        lo, hi = off[r] + np.searchsorted(places, a), off[r] + np.searchsorted(places, b)
                        inside = np.flatnonzero((tok.start < hi) & (tok.end > lo))
                        tag[inside] = INSIDE
                        tag[inside[:1]] = BEGIN
                found = [_windows(tok, tag, salts[i:j]), _planted_windows([part[off[r] : off[r + 1]].tobytes().decode() for r in range(j - i)], salts[i:j])]
                feats, tags = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(list(feats.reshape(len(feats), -1)), type=pa.list_(pa.int32())), pa.array(list(tags.astype(np.int32)), type=pa.list_(pa.int32()))], names=["feats", "tags"])

    found = some.mapInArrow(run, "feats array<int>, tags array<int>").distinct().orderBy(F.xxhash64("feats"), "feats", "tags").limit(windows).toPandas()
    if not len(found):
        return fit_crf(np.zeros((0, WINDOW, len(GROUPS) + 2), dtype=np.int32), np.zeros((0, WINDOW), dtype=np.int64))
    feats = np.stack(found["feats"].to_list()).reshape(len(found), WINDOW, -1).astype(np.int64)
    return fit_crf(feats, np.stack(found["tags"].to_list()).astype(np.int64))


def scan_secrets(df: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans array<struct<kind, start, end>> by start, then kind: assign, access, hex, then secret.

    The first three are the patterns' matches; ``secret`` are runs of tokens that the field tags and no pattern touches.
    Places are code points. A null text counts as empty, rows are treated alone, an empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.moves))  # N_FEATURES x 3 numbers
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = (*KINDS, "secret")

    def run(batches):
        crf = Crf(*shared.value)
        for batch in batches:
            buf, offsets = bytehash.text_buffer(batch.column("text"))
            for i, j in bytehash.row_chunks(offsets, CHUNK):
                part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                tok = tokens_of(part, off)
                first = np.concatenate([[True], tok.row[1:] != tok.row[:-1]])[: len(tok.row)]
                tags = crf.decode(crf.emissions(tok.feats), first)
                tagged = np.flatnonzero(tags != OUTSIDE)
                flagged = _flagged(part, off)
                flagged[tok.row[tagged]] = True
                out = [[]] * (j - i)
                for r in np.flatnonzero(flagged):
                    raw = part[off[r] : off[r + 1]]
                    spans = base_spans(raw.tobytes().decode())
                    mine = tagged[np.searchsorted(tok.row[tagged], r) : np.searchsorted(tok.row[tagged], r + 1)]
                    if len(mine):
                        places, base = _char_places(raw), list(spans)
                        for run_ in np.split(mine, np.flatnonzero((np.diff(mine) > 1) | (tags[mine[1:]] == BEGIN)) + 1):
                            a, b = int(places[tok.start[run_[0]] - off[r]]), int(places[tok.end[run_[-1]] - off[r]])
                            if not any(a < e and s < b for s, _, e in base):
                                spans.append((a, 3, b))
                    out[r] = [{"kind": kinds[k], "start": a, "end": b} for a, k, b in sorted(spans)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(out, type=kind)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: int, end: int>>").withColumnRenamed("doc_id", id_col)
