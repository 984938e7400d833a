"""Secret scans: base patterns and a linear-chain conditional random field.

The field tags tokens (runs without white space) as secret begin, inside or outside from their
shape, the words before and after them and features of the whole text, and is decoded by Viterbi.
Weights are trained here on seeded synthetic sentences by the exact gradient of the likelihood
(forward and backward sums over the batch). Ordinary words (short, of letters and punctuation) are
one observation; the trained weights keep them outside by more than all transitions could gain,
which ``Field.check`` proves, so that decoding only needs the stretches around other tokens, seen
with the two words before them and the one after.

Spans are code points, end exclusive. Base kinds are ``assign``, ``access`` and ``hex``; the field
adds ``crf`` spans, whole, unless base spans cover them wholly. Defined results: null text is empty and has no spans;
equal texts have equal spans; rows are kept, also repeated ones; extra columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skald.llm.shared import text_slices, whole_text

# The base patterns, their least lengths and the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

#: Tokens that are not ordinary words: with a digit or a joining sign, long, or a cue word.
_UNUSUAL = re.compile(r"(?<!\S)(?:[^\s0-9=:_+/\\-]*+[0-9=:_+/\\-]\S*|\S{20,}|(?i:[\"'(]?(?:password|passwd|pwd|secret|token|key|bearer|credentials?|auth)[\"')]?)(?!\S))")
_WORD = re.compile(r"\S+")
_CUE = re.compile(r"password|passwd|pwd|passphrase|secret|token|key|bearer|credential|auth", re.IGNORECASE)
_PREFIX = re.compile(r"^(?:ghp_|gho_|sk[-_]|pk[-_]|xox[abp]-|AKIA|ASIA|AIza|eyJ|glpat-|npm_)")
_STRIP = "\"'`()[]{}<>,;.!?"
BEGIN, INSIDE, OUTSIDE = range(3)
ORDINARY = 0  # the one feature of ordinary words
N_FEATURES = 80


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _step(value: float, *tops: float) -> int:
    return sum(value >= t for t in tops)


@functools.lru_cache(100_000)
def features(token: str) -> tuple[int, ...]:
    """Shape features of one token."""
    if not _UNUSUAL.match(token):
        return (ORDINARY,)
    head, sign, value = token.partition("=") if "=" in token.strip("=") else ("", "", token)
    if sign and not _CUE.search(head):
        value = token
    core = value.strip(_STRIP)
    n = len(core)
    digits, upper, lower = sum(c.isdigit() for c in core), sum(c.isupper() for c in core), sum(c.islower() for c in core)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in core]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False) if "o" not in (a, b))
    out = [1, 2 + _step(n, 4, 8, 12, 16, 20, 28, 40), 10 + (_step(digits / n, 0.001, 0.1, 0.3, 0.6, 1.0) if n else 0), 16 + _step(turns, 1, 2, 4, 7)]
    out.append(21 + (upper > 0) + 2 * (lower > 0) + 4 * (digits > 0))
    if re.fullmatch(r"[0-9a-fA-F]+", core):
        out.append(30 + _step(n, 8, 16, 32))
    if re.fullmatch(r"[A-Za-z0-9+/=_-]+", core):
        out.append(34 + _step(n, 12, 20, 32))
    out += [i for i, hit in ((38, "@" in core), (39, "://" in core or core.startswith("www.")), (40, core.count(".") >= 2), (41, bool(sign) and value != token), (42, token[:1] in "\"'`"), (43, token[-1:] in ":="), (44, bool(_PREFIX.match(core))), (45, "/" in core[:1] or "\\" in core), (46, core.startswith("-----")), (47, not core.isascii()), (48, core.count("-") >= 2), (49, core.count("_") >= 1), (50, bool(re.fullmatch(r"[\d.,:/%+-]+", core))), (51, bool(_CUE.fullmatch(core.strip(":=")))), (52, turns >= 4 and n >= 12 and digits > 1), (53, n >= 16 and digits > 1 and upper > 1 and lower > 1)) if hit]
    return tuple(out)


@functools.lru_cache(100_000)
def cues(token: str) -> tuple[bool, bool]:
    """What a token tells its neighbours: it names a secret, it assigns."""
    bare = token.strip(_STRIP + ":=")
    return bool(_CUE.fullmatch(bare) or _CUE.search(bare) and re.fullmatch(r"[A-Za-z_]+", bare)), token[-1:] in ":="


def file_features(text: str, unusual: int) -> tuple[int, ...]:
    """How dense unusual tokens are, and whether the text speaks of secrets at all."""
    return 60 + _step(unusual * 100 / (len(text) / 6 + 1), 1, 5, 25), 64 + bool(_CUE.search(text))


def observations(tokens: list[str]) -> list[tuple[int, ...]]:
    """Each token's features with those of its neighbours."""
    told = [cues(t) for t in tokens]
    out = []
    for i, token in enumerate(tokens):
        own = list(features(token))
        for d, at in ((1, 66), (2, 68)):
            if i >= d:
                own += [at + k for k in (0, 1) if told[i - d][k]]
        if i + 1 < len(tokens):
            own += [70 + k for k in (0, 1) if told[i + 1][k]]
        out.append(tuple(own))
    return out


class Field:
    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves
        self.rows, self.table = weights.tolist(), moves.tolist()
        self.check()

    def check(self) -> None:
        """Ordinary words stay outside whatever stands around them."""
        w = self.weights
        gain = lambda ids, s: sum(max(0.0, w[i, s] - w[i, OUTSIDE]) for i in ids)
        worst = max(w[ORDINARY, s] - w[ORDINARY, OUTSIDE] + gain(range(60, 72), s) for s in (BEGIN, INSIDE))
        if worst + 2 * float(self.moves.max() - self.moves.min()) >= 0:
            raise ValueError("the field's weights don't keep ordinary words outside")

    def decode(self, seen: list[tuple[int, ...]], shared: tuple[int, ...]) -> list[int]:
        """The best labels by Viterbi; the words on either side of the stretch are outside."""
        base = [sum(self.rows[i][s] for i in shared) for s in range(3)]
        moves, best, back = self.table, None, []
        for ids in seen:
            emit = [base[s] + sum(self.rows[i][s] for i in ids) for s in range(3)]
            if best is None:
                best = [moves[OUTSIDE][s] + emit[s] for s in range(3)]
                continue
            come = [max(range(3), key=lambda p, s=s: best[p] + moves[p][s]) for s in range(3)]
            best = [best[come[s]] + moves[come[s]][s] + emit[s] for s in range(3)]
            back.append(come)
        label = max(range(3), key=lambda s: best[s] + moves[s][OUTSIDE])
        labels = [label]
        for come in reversed(back):
            label = come[label]
            labels.append(label)
        return labels[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        unusual = [(m.start(), m.end()) for m in _UNUSUAL.finditer(text)]
        if not unusual:
            return []
        shared = file_features(text, len(unusual))
        found: list[tuple[int, int]] = []
        stretch: list[tuple[int, int]] = []
        ended = 0
        for k, (a, b) in enumerate(unusual):
            stretch.append((a, b))
            after = unusual[k + 1][0] if k + 1 < len(unusual) else len(text)
            between = [(m.start(), m.end()) for m in itertools.islice(_WORD.finditer(text, b, after), 3)]
            if k + 1 < len(unusual) and len(between) <= 2:
                stretch += between
                continue
            # All words between stretches are outside, but what they tell their neighbours counts.
            before = text[ended : stretch[0][0]].rsplit(None, 2)[-2:]
            tokens = [*before, *(text[x:y] for x, y in stretch), *(text[x:y] for x, y in between[:1])]
            seen = observations(tokens)[len(before) :][: len(stretch)]
            ended = b
            begin = None
            for (x, y), label in zip(stretch, self.decode(seen, shared), strict=True):
                if label == OUTSIDE or label == BEGIN:
                    if begin is not None:
                        found.append((begin, end))
                        begin = None
                if label != OUTSIDE:
                    begin, end = x if begin is None else begin, y
            if begin is not None:
                found.append((begin, end))
            stretch = []
        return [_trimmed(text, a, b) for a, b in found]


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without quotes and closing punctuation around it."""
    part = text[a:b]
    left, right = len(part) - len(part.lstrip("\"'`([{<,;")), len(part) - len(part.rstrip("\"'`)]}>,;.!?"))
    return (a + left, b - right) if left + right < len(part) else (a, b)


def _sentence(rng: random.Random) -> tuple[list[str], list[int]]:
    """A synthetic labelled sentence: ordinary text, harmless odd tokens, now and then a secret."""
    letters, marks = "etaoinshrdlucmfwypvbgkqjxzéüñçß", ["", "", "", "", ",", ".", "!!", "?", ";"]
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: (lambda w: rng.choice([w, w, w, w.capitalize(), w.upper()]) + rng.choice(marks))(pick(letters, rng.randint(1, 13)))

    def odd() -> list[str]:
        n = rng.randint
        return rng.choice([
            lambda: [str(n(0, 99999))], lambda: [pick("0123456789", 16)], lambda: [f"{n(1, 255)}.{n(0, 255)}.{n(0, 255)}.{n(0, 255)}"],
            lambda: [f"{pick(letters[:20], 6)}.{n(1, 99)}@mail{n(1, 9)}.example.com"], lambda: [f"https://{pick(letters[:20], 7)}.com/{pick(letters[:20], 5)}/{n(1, 9999)}?id={n(1, 99)}"],
            lambda: [f"20{n(10, 29)}-{n(10, 12)}-{n(10, 28)}"], lambda: [f"{n(0, 23)}:{n(10, 59)}"], lambda: [f"+{n(1, 99)}", pick("0123456789", 3), pick("0123456789", 7)], lambda: [f"v{n(0, 9)}.{n(0, 20)}.{n(0, 9)}"],
            lambda: [pick(letters, n(20, 45))], lambda: [f"{pick(letters[:20], 5)}-{pick(letters[:20], 6)}"], lambda: [f"{pick(letters[:20], 4)}_{pick(letters[:20], 6)}"], lambda: [f"{n(1, 999)},{n(100, 999)}.{n(10, 99)}"],
            lambda: [f"{pick(letters[:20], 6)}:"], lambda: ["the", rng.choice(["key", "token", "secret", "password"]), word(), word()], lambda: [f"/usr/{pick(letters[:20], 5)}/{pick(letters[:20], 6)}{n(1, 9)}"],
            lambda: [f"{pick(letters[:20], 4)}={n(1, 9999)}"], lambda: ["=", ":", "|"][n(0, 2) :][:1], lambda: [f"({n(1, 99)})"], lambda: [f"{pick('ABCDEFGH', 2)}{n(100, 9999)}"], lambda: ["-" * n(3, 40)], lambda: ["=" * n(3, 40)], lambda: [f"{n(1, 12)}/{n(1, 28)}/20{n(10, 29)}"],
            lambda: [f"{pick('0123456789abcdef', 8)}-{pick('0123456789abcdef', 4)}-{pick('0123456789abcdef', 4)}-{pick('0123456789abcdef', 4)}-{pick('0123456789abcdef', 12)}"],
        ])()

    def value() -> str:
        return rng.choice([lambda: pick(mixed, rng.randint(16, 48)), lambda: pick("0123456789abcdef", rng.choice([18, 24, 32, 40, 64])), lambda: pick(mixed + "+/", rng.randint(24, 64)) + rng.choice(["", "=", "=="]), lambda: pick(mixed + "!@#$%&", rng.randint(10, 20))])()

    def secret() -> tuple[list[str], list[int]]:
        cue = rng.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth_token", "credential"])
        cue = rng.choice([cue, cue.upper(), cue.capitalize()])
        v = value()
        return rng.choice([
            lambda: ([f"{cue}:", v], [2, 0]), lambda: ([cue, "=", f'"{v}"'], [2, 2, 0]), lambda: ([f"{cue}={v}"], [0]), lambda: ([cue, ":", v], [2, 2, 0]), lambda: ([rng.choice(["Bearer", "bearer"]), v], [2, 0]), lambda: ([cue, "is", pick(mixed, rng.randint(16, 40))], [2, 2, 0]),
            lambda: ([rng.choice(["ghp_", "sk-", "sk_live_", "xoxb-", "glpat-", "AIza"]) + pick(mixed, 32)], [0]), lambda: (["AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)], [0]), lambda: ([pick(mixed, rng.randint(32, 64))], [0]), lambda: ([pick("0123456789abcdef", rng.choice([32, 40, 64]))], [0]),
            lambda: ([f"{cue}:", *(pick(mixed, 8) for _ in range(3))], [2, 0, 1, 1]), lambda: (["-----BEGIN", "PRIVATE", "KEY-----", *(pick(mixed + "+/", 64) for _ in range(3)), "-----END", "PRIVATE", "KEY-----"], [0, 1, 1, 1, 1, 1, 1, 1, 1]),
        ])()

    tokens, labels = [], []
    for _ in range(rng.randint(1, 3)):
        for part in ([word() for _ in range(rng.randint(1, 5))], odd() if rng.random() < 0.6 else []):
            tokens += part
            labels += [OUTSIDE] * len(part)
        if rng.random() < 0.45:
            part, own = secret()
            tokens += part
            labels += own
    tokens.append(word())
    return tokens, [*labels, OUTSIDE]


@functools.cache
def trained(sentences: int = 1500, rounds: int = 60, seed: int = 7) -> Field:
    """Weights from ``sentences`` synthetic sentences by ``rounds`` steps of Adam; the same ones every time."""
    rng = random.Random(seed)
    data = [_sentence(rng) for _ in range(sentences)]
    longest = max(len(t) for t, _ in data)
    rows, at, gold = [], [], np.full((sentences, longest), OUTSIDE)
    live = np.zeros((sentences, longest), bool)
    for n, (tokens, labels) in enumerate(data):
        text = " ".join(tokens)
        shared = file_features(text * 20, 20 * len(_UNUSUAL.findall(text)) // rng.choice([1, 5, 20]))
        for t, ids in enumerate(observations(tokens)):
            rows += [n * longest + t] * (len(ids) + len(shared))
            at += [*ids, *shared]
        gold[n, : len(labels)] = labels
        live[n, : len(labels)] = True
    rows, at = np.array(rows), np.array(at)
    params = np.zeros((N_FEATURES + 3, 3))
    params[ORDINARY, OUTSIDE] = 5
    m, v = np.zeros_like(params), np.zeros_like(params)
    ends = live.sum(1) - 1
    for step in range(1, rounds + 1):
        weights, moves = params[:N_FEATURES], params[N_FEATURES:]
        emit = np.stack([np.bincount(rows, weights[at, s], sentences * longest) for s in range(3)], 1).reshape(sentences, longest, 3)
        ahead = np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0] + moves[OUTSIDE]
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves[None], 1) + emit[:, t]
        behind = np.zeros_like(emit)
        for t in range(longest - 1, -1, -1):
            inner = np.logaddexp.reduce(moves[None] + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2) if t + 1 < longest else behind[:, t]
            behind[:, t] = np.where((ends == t)[:, None], moves[:, OUTSIDE][None], inner)
        total = np.logaddexp.reduce(ahead[np.arange(sentences), ends] + moves[:, OUTSIDE], 1)
        chance = np.exp(ahead + behind - total[:, None, None]) * live[..., None]
        wrong = (np.eye(3)[gold] * live[..., None] - chance).reshape(-1, 3)
        grad = np.zeros_like(params)
        for s in range(3):
            grad[:N_FEATURES, s] = np.bincount(at, wrong[rows, s], N_FEATURES)
        both = live[:, 1:]
        pair = np.exp(ahead[:, :-1, :, None] + moves[None, None] + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both[..., None, None]
        seen = np.zeros((3, 3))
        np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        grad[N_FEATURES:] = seen - pair.sum((0, 1))
        grad = grad / sentences - 1e-3 * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    # Ordinary words get what check() asks for, should training have stopped short of it.
    weights, moves = params[:N_FEATURES].copy(), params[N_FEATURES:]
    gain = max(np.maximum(0, weights[60:72, s] - weights[60:72, OUTSIDE]).sum() + weights[ORDINARY, s] for s in (BEGIN, INSIDE))
    weights[ORDINARY, OUTSIDE] = max(weights[ORDINARY, OUTSIDE], gain + 2 * (moves.max() - moves.min()) + 1)
    return Field(weights, moves.copy())


def _covered(a: int, b: int, spans: list[tuple[int, int, str]]) -> bool:
    for x, y, _ in sorted(spans):
        if x > a:
            break
        a = max(a, y)
    return a >= b


def all_spans(text: str, field: Field) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    added = [(a, b, "crf") for a, b in field.spans(text) if not _covered(a, b, base)]
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans``."""
    field = trained()
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for text in texts:
                spans = all_spans(text, field)
                base = _written([s for s in spans if s[2] != "crf"])
                for column, value in zip(out, (*(sum(s[2] == k for s in spans) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), _written(spans)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[1:], strict=True))], schema=schema)

    return whole_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; all columns stay."""
    field = trained()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            clean = [None if old is None else redacted(t, all_spans(t, field), mark) for t, old in zip(texts, rows.column("text").to_pylist(), strict=True)]
            yield rows.set_column(names.index("text"), rows.schema.field("text"), pa.array(clean, rows.schema.field("text").type))

    return docs.mapInArrow(run, docs.schema)
