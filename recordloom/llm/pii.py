"""Personal data by a skip-chain conditional random field.

Tokens are runs between white space (of any script), brackets, semicolons and
changes between a spaced and an unspaced script, cut further at commas, colons
and around the host of a URL where no number or time goes on.  A token that has
no digit, no @, no = and no key prefix can carry no personal data of the kinds
below, so its label is clamped to O and it only serves as context; all others
are nodes.  Neighbouring
nodes share transition potentials, and a node and the next node of the document
that is the same (or has the same shape) share skip potentials, however far
apart they are.  The weights maximise the pseudo-likelihood of generated
sentences; labels come from loopy sum-product message passing over the nodes of
a document, so that what the context reveals once labels every repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import text as T

LABELS = ("O", "EMAIL", "PHONE", "CARD", "IP", "SECRET", "ID")
_TRIM = "\"'`.,;:!?)]}>*#$%&|"
_LEAD = "\"'`([{<*#$%&|"
_CUES = {
    "PHONE": {"phone", "tel", "telephone", "call", "fax", "mobile", "cell"},
    "CARD": {"card", "visa", "mastercard", "amex", "credit"},
    "IP": {"ip", "host", "server", "address", "addr"},
    "EMAIL": {"email", "mail", "e-mail", "contact", "write"},
    "SECRET": {"token", "password", "passwd", "pwd", "secret", "key", "apikey", "api_key", "bearer"},
    "ID": {"ssn", "social", "passport", "tax"},
    "NUMBER": {"version", "chapter", "page", "section", "figure", "table", "order", "year", "item", "no", "license"},
}
_PATTERNS = {
    "email": re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
    "country": re.compile(r"\+\d{1,3}"),
    "area": re.compile(r"\(?\d{2,4}\)?"),
    "area_closed": re.compile(r"\(\d{2,4}\)"),
    "local": re.compile(r"\d{3,4}[-.]\d{4}"),
    "phone": re.compile(r"\+?\d{0,3}[-. ]?\(?\d{2,4}\)?[-.]\d{3,4}[-.]\d{3,4}"),
    "card": re.compile(r"[3-6]\d{12,18}"),
    "cards": re.compile(r"[3-6]\d{3}(?:-\d{4}){3}"),
    "group": re.compile(r"\d{4}"),
    "ssn": re.compile(r"\d{3}-\d{2}-\d{4}"),
    "assigned": re.compile(r"(?i)(?:\w*(?:token|password|passwd|pwd|secret|key)\w*)[=:][\"']?\S{6,}"),
    "key_prefix": re.compile(r"(?:(?:AKIA|ASIA|ghp_|sk-|sk_)\w{10,}|xox[abprs]-[\w-]{8,})"),
    "hex": re.compile(r"[0-9a-f]{16,}"),
    "mixed": re.compile(r"(?=\S*\d)(?=\S*[A-Za-z])[\w+/=-]{16,}"),
    "number": re.compile(r"\d+"),
    "decimal": re.compile(r"\d+(?:[.,]\d+)+%?"),
    "small": re.compile(r"\d{1,3}"),
    "year": re.compile(r"(?:1[5-9]|20)\d\d"),
    "date": re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"),
    "time": re.compile(r"\d{1,2}:\d{2}(?::\d{2})?"),
    "equals": re.compile(r"="),
}
_KEY_BYTES = [b"AKIA", b"ASIA", b"ghp_", b"sk-", b"sk_", *(b"xox%c-" % c for c in b"abprs")]
_NAMES = [*_PATTERNS, "luhn", "quoted", "has_at", "has_digit", "long", *(f"cue1_{c}" for c in _CUES), *(f"cue2_{c}" for c in _CUES), "after_equals", "before_node", "after_node", "in_fours", "led", "bias"]
_AT = {n: k for k, n in enumerate(_NAMES)}


#: Scripts that are written without spaces: CJK, kana, hangul, full-width forms, Thai.
_UNSPACED = "\u0e00-\u0e7f\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef"
_RUN = re.compile(rf"[^\s;|<>\[\]{{}}{_UNSPACED}]+|[{_UNSPACED}]+")
_INNER = re.compile(r"[,:()/]")
_URL = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]*)(?::\d+)?(.*)", re.S)
_PART = re.compile(r"\(\d{2,4}\)|(?:(?<=\d)[,:](?=\d)|[^,:()])+")
_ADDRESS = re.compile(r"((?:\d{1,3}\.){3}\d{1,3})[:/]")


def tokens_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of all tokens, in order; what lies between them is space or separators."""
    out = []
    for m in _RUN.finditer(text):
        run, at = m.group(), m.start()
        if len(run) < 4 or not _INNER.search(run):
            out.append((at, m.end(), run))
            continue
        if url := _URL.search(run):
            out += _parts(run[: url.start()], at)
            out += [(at + url.start(k), at + url.end(k), url.group(k)) for k in (1, 2, 3, 4) if url.group(k)]
        elif a := _ADDRESS.match(run):
            out.append((at, at + a.end(1), a.group(1)))
            out += _parts(run[a.end() :], at + a.end())
        else:
            out += _parts(run, at)
    return out


def _parts(run: str, at: int) -> list[tuple[int, int, str]]:
    return [(at + m.start(), at + m.end(), m.group()) for m in _PART.finditer(run)]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def core(token: str) -> str:
    """The token without punctuation around it."""
    return token.lstrip(_LEAD.replace("(", "")).rstrip(_TRIM.replace(")", ""))


def is_open(token: str) -> bool:
    """Whether a token is a node: a digit, @, = or a key prefix."""
    return any(c in "0123456789@=" for c in token) or any(token.lstrip(_LEAD).startswith(k.decode()) for k in _KEY_BYTES)


def shape(token: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d", "9", token)))


def groups(tokens: list[str], positions: list[int]) -> dict[int, list[str]]:
    """Features of nodes of four digits by their place: whether there are four (or eight, ...) of them in a row, and whether a prefix leads the row."""
    out: dict[int, list[str]] = {}
    k = 0
    while k < len(positions):
        last = k
        while last < len(positions) and positions[last] - positions[k] == last - k and _PATTERNS["group"].fullmatch(core(tokens[positions[last]])):
            last += 1
        if last > k:
            led = k > 0 and positions[k - 1] == positions[k] - 1 and tokens[positions[k - 1]][:1] in "+0("
            own = ["in_fours"] * ((last - k) % 4 == 0) + ["led"] * led
            out.update((p, own) for p in positions[k:last])
        k = max(last, k + 1)
    return out


def node_features(token: str, left: list[str], after_node: bool, before_node: bool, more: list[str]) -> list[int]:
    """Indexes of the features of a node; left: up to two closed or open tokens before it, the nearest first; more: names of others that it has."""
    own = core(token)
    out = [_AT[n] for n, p in _PATTERNS.items() if (p.search(own) if n == "equals" else p.fullmatch(own))]
    digits = re.sub(r"\D", "", own)
    if 13 <= len(digits) <= 19 and luhn(digits):
        out.append(_AT["luhn"])
    for name, true in (("quoted", token[:1] in "\"'"), ("has_at", "@" in own), ("has_digit", bool(digits)), ("long", len(own) >= 16), ("after_node", after_node), ("before_node", before_node), ("after_equals", bool(left) and left[0] in ("=", ":"))):
        if true:
            out.append(_AT[name])
    words = [w for w in (re.sub(r"[^a-z_-]", "", t.lower()) for t in left) if w]
    for k, word in enumerate(words[:2]):
        out += [_AT[f"cue{k + 1}_{c}"] for c, cues in _CUES.items() if word in cues]
    out += [_AT[n] for n in more]
    out.append(_AT["bias"])
    return out


@dataclass(frozen=True)
class Model:
    unary: np.ndarray  # features by labels
    chain: np.ndarray  # label on the left by label on the right
    skip: np.ndarray  # symmetric


def graph(tokens: list[str], positions: list[int]) -> tuple[list[list[int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Features, chain edges and skip edges of the nodes, which stand at these positions among all tokens."""
    features, chain, skip = [], [], []
    fours = groups(tokens, positions)
    last_same: dict[str, int] = {}
    last_shape: dict[str, int] = {}
    for k, at in enumerate(positions):
        after = k > 0 and positions[k - 1] == at - 1
        before = k + 1 < len(positions) and positions[k + 1] == at + 1
        features.append(node_features(tokens[at], [tokens[at - d] for d in (1, 2, 3) if at - d >= 0], after, before, fours.get(at, [])))
        if after:
            chain.append((k - 1, k))
        own = core(tokens[at])
        kind = shape(own)
        same, like = last_same.get(own), last_shape.get(kind)
        if same is not None and not (after and same == k - 1):
            skip.append((same, k))
        if like is not None and like != same and len(kind) >= 6 and not (after and like == k - 1):
            skip.append((like, k))
        last_same[own] = last_shape[kind] = k
    return features, chain, skip


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _entity(rng: np.random.Generator, label: str) -> tuple[list[str], list[str]]:
    """Tokens of an entity and the words that may come before it."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a, b: "".join(rng.choice(list(letters), rng.integers(a, b)))
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    if label == "EMAIL":
        return [f"{word(3, 9)}{pick('.', '_', '-', '')}{pick(word(2, 6), _digits(rng, 2))}@{word(3, 8)}{pick('', _digits(rng, 1))}.{pick('com', 'org', 'example.com', 'net', 'co.uk')}"], list(_CUES[label])
    if label == "PHONE":
        area, a, b = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        return pick([f"+{rng.integers(1, 99)}", f"({area})", f"{a}-{b}"], [f"({area})", f"{a}-{b}"], [f"{area}-{a}-{b}"], [f"+{rng.integers(1, 99)}-{area}-{a}-{b}"], [f"+{rng.integers(1, 99)}", area, f"{a}-{b}"], [f"+{rng.integers(1, 99)}", area[:2], b, _digits(rng, 4)], [f"0{area[:2]}", b, _digits(rng, 4)], [f"+{rng.integers(1, 99)}", area, a, b]), list(_CUES[label])
    if label == "CARD":
        head = f"{rng.integers(3, 7)}{_digits(rng, 14)}"
        number = next(head + str(d) for d in range(10) if luhn(head + str(d)))
        return pick([number], [number], ["-".join(number[k : k + 4] for k in range(0, 16, 4))], [number[k : k + 4] for k in range(0, 16, 4)]), list(_CUES[label])
    if label == "IP":
        address = ".".join(str(int(x)) for x in rng.integers(1, 255, 4))
        return [pick(address, address, address, f"{address}:{rng.integers(80, 9999)}", f"http://{address}/{word(2, 6)}", f"http://{address}:{rng.integers(80, 9999)}/{word(1, 6)}")], list(_CUES[label])
    if label == "ID":
        return [f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}"], list(_CUES[label])
    secret = "".join(rng.choice(list(pick("0123456789abcdef", letters + "0123456789" + letters.upper())), rng.integers(16, 41)))
    return pick([f"{pick('password', 'token', 'api_key', 'secret')}={secret}"], [f'"{secret}"'], [secret], ["AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16))], [f"{pick('xoxb-', 'xoxp-', 'ghp_', 'sk_')}{secret[:24]}"], [f"xoxb-{word(5, 9)}-{word(8, 14)}"]), list(_CUES[label])


def _plain(rng: np.random.Generator) -> tuple[list[str], list[str]]:
    """A node that is no personal data, with words that may come before it."""
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    n = lambda k: _digits(rng, k)
    word = lambda: "".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9)))
    return [pick(str(rng.integers(0, 999)), str(rng.integers(1800, 2030)), f"{rng.integers(0, 99)}.{rng.integers(0, 9)}", f"{rng.integers(1, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 20)}", f"{n(2)}%", f"{rng.integers(1, 28)}/{rng.integers(1, 12)}/20{n(2)}", f"20{n(2)}-0{rng.integers(1, 9)}-1{n(1)}", f"{rng.integers(10, 23)}:{rng.integers(10, 59)}", f"{rng.integers(1, 9)},{n(3)},{n(3)}", n(6), n(9), "=", "x=1", "a=b", "@", f"/{n(4)}/{n(2)}/{word()}?id={n(9)}", f"?q={word()}", f"B{n(2)}", f"{n(1)}th", f"covid-{n(2)}", f"{n(4)}")], [*_CUES["NUMBER"], "the", "of"]


def training_documents(n: int = 1500, seed: int = 8) -> list[tuple[list[str], list[int]]]:
    """Generated documents as tokens and labels; entities may repeat, with a cue before the first mention or none."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        tokens, labels = [], []
        held: list[tuple[list[str], int]] = []
        for _ in range(int(rng.integers(2, 9))):
            for _ in range(int(rng.integers(0, 6))):
                tokens.append("".join(rng.choice(list("aeioulnrst"), rng.integers(1, 8))))
                labels.append(0)
            if held and rng.random() < 0.3:
                entity, label = held[int(rng.integers(0, len(held)))]
                cues: list[str] = []
            else:
                label = int(rng.integers(0, len(LABELS))) if rng.random() < 0.7 else 0
                entity, cues = _entity(rng, LABELS[label]) if label else _plain(rng)
                held.append((entity, label))
            if cues and rng.random() < 0.4:
                tokens += [cues[int(rng.integers(0, len(cues)))], *(["="] if label == 5 and rng.random() < 0.5 else [])]
                labels += [0] * (len(tokens) - len(labels))
            mark = ["", "", "", ".", ",", ")"][int(rng.integers(0, 6))]
            for own in [*entity[:-1], entity[-1] + mark]:
                parts = [t for _, _, t in tokens_of(own)]
                tokens += parts
                labels += [0 if LABELS[label] == "IP" and not _PATTERNS["ip"].fullmatch(core(t)) else label for t in parts]
        out.append((tokens, labels))
    return out


def train(documents: list[tuple[list[str], list[int]]] | None = None, rounds: int = 300, ridge: float = 1e-3) -> Model:
    """Weights of largest pseudo-likelihood: each node given its features and the true labels of its neighbours."""
    n_labels, n_features = len(LABELS), len(_NAMES)
    rows, y, left, right, near = [], [], [], [], []
    for tokens, labels in documents or training_documents():
        positions = [k for k, t in enumerate(tokens) if is_open(t)]
        features, chain, skip = graph(tokens, positions)
        truth = [labels[p] for p in positions]
        lefts, rights = dict((b, a) for a, b in chain), dict(chain)
        around: dict[int, list[int]] = {}
        for a, b in skip:
            around.setdefault(a, []).append(truth[b])
            around.setdefault(b, []).append(truth[a])
        for k, f in enumerate(features):
            rows.append(f)
            y.append(truth[k])
            left.append(truth[lefts[k]] if k in lefts else -1)
            right.append(truth[rights[k]] if k in rights else -1)
            near.append(np.bincount(around.get(k, []), minlength=n_labels)[:n_labels])
    x = np.zeros((len(rows), n_features + 3 * n_labels))
    for k, f in enumerate(rows):
        x[k, f] = 1.0
        if left[k] >= 0:
            x[k, n_features + left[k]] = 1.0
        if right[k] >= 0:
            x[k, n_features + n_labels + right[k]] = 1.0
        x[k, n_features + 2 * n_labels :] = near[k]
    target = np.eye(n_labels)[y]
    w, momentum, second = np.zeros((x.shape[1], n_labels)), np.zeros((x.shape[1], n_labels)), np.zeros((x.shape[1], n_labels))

    def tie(m: np.ndarray) -> np.ndarray:
        """One chain table for both directions and a symmetric skip table."""
        a, b, c = n_features, n_features + n_labels, n_features + 2 * n_labels
        both = (m[a:b] + m[b:c].T) / 2
        m[a:b], m[b:c], m[c:] = both, both.T, (m[c:] + m[c:].T) / 2
        return m

    for t in range(1, rounds + 1):
        s = x @ w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = tie(x.T @ (p - target) / len(x) + ridge * w)
        momentum = 0.9 * momentum + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        w -= 0.1 * (momentum / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w = tie(w)
    a = n_features
    return Model(w[:a], w[a : a + n_labels], w[a + 2 * n_labels :])


@cache
def trained() -> Model:
    """The model of this process."""
    return train()


def marginals(unary: np.ndarray, edges: np.ndarray, tables: np.ndarray, rounds: int = 1000, damp: float = 0.3) -> np.ndarray:
    """Loopy sum-product beliefs. edges: (a, b) pairs; tables: log potentials, label of a by label of b, for each edge.

    Messages are passed until none changes any more, which takes about as many
    rounds as the longest chain of edges; rounds only ends what oscillates.
    """
    n, k = unary.shape
    if not len(edges):
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), k))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, message)
        out = belief[source] - message[back]
        out = out[:, :, None] + table
        top = out.max(axis=1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        changed = np.abs(new - message).max()
        message = (1 - damp) * new + damp * message
        if changed < 1e-4:
            break
    belief = unary.copy()
    np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def label_nodes(tokens: list[str], positions: list[int], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the nodes and their marginals."""
    features, chain, skip = graph(tokens, positions)
    unary = np.array([model.unary[f].sum(axis=0) for f in features])
    edges = np.array(chain + skip, dtype=np.int64).reshape(-1, 2)
    tables = np.concatenate([np.broadcast_to(model.chain, (len(chain), *model.chain.shape)), np.broadcast_to(model.skip, (len(skip), *model.skip.shape))])
    p = marginals(unary, edges, tables)
    label = p.argmax(axis=1)
    return label, p[np.arange(len(p)), label]


def spans(text: str, model: Model) -> list[tuple[int, int, str, float]]:
    """(start, end, label, score) of the entities of one text, in characters; score is the least marginal of its tokens."""
    found = tokens_of(text)
    tokens = [f[2] for f in found]
    positions = [k for k, t in enumerate(tokens) if is_open(t)]
    if not positions:
        return []
    label, score = label_nodes(tokens, positions, model)
    out: list[tuple[int, int, str, float]] = []
    last = -2
    for k, at in enumerate(positions):
        if label[k] == 0:
            continue
        start, _, token = found[at]
        body = core(token)
        start += token.find(body)
        name = LABELS[label[k]]
        joined = out and last == at - 1 and out[-1][2] == name and name in ("PHONE", "CARD") and not text[out[-1][1] : start].strip(" \t\u00a0()")
        if joined:
            out[-1] = (out[-1][0], start + len(body), name, min(out[-1][3], float(score[k])))
        else:
            out.append((start, start + len(body), name, float(score[k])))
        last = at
    return out


_CLASS = np.zeros(256, dtype=bool)
_CLASS[[*range(48, 58), 64, 61]] = True


def may_hold(column: pa.Array) -> np.ndarray:
    """Whether a text can have a node at all."""
    data, offsets = T.buffers(column)
    hits = np.concatenate([[0], np.cumsum(_CLASS[data])])
    some = hits[offsets[1:]] > hits[offsets[:-1]]
    for key in _KEY_BYTES:
        some |= pc.match_substring(column, key.decode()).to_numpy(zero_copy_only=False)
    return some


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, label, score) of all personal data; start and end count characters, end excluded.

    A node gets its most probable label, of equally probable ones the first of
    LABELS.  Null and empty texts have none; a very long text is one chain; a row with a null id is searched like any
    other; repeated rows repeat.  Other columns are ignored whatever their
    names.  An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), T.as_large(batch.column(1))
            rows, found = [], []
            for i, j in T.pieces(column):
                for k in np.flatnonzero(may_hold(column.slice(i, j - i))) + i:
                    own = spans(column[int(k)].as_py(), held.value)
                    rows += [int(k)] * len(own)
                    found += own
            if rows:
                start, end, label, score = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(label), pa.array(score)], names=["doc_id", "start", "end", "label", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return own.mapInArrow(run, "doc_id long, start long, end long, label string, score double")


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """docs with personal data in text replaced by its label in brackets.

    Null texts stay null, texts without any stay as they are, however long;
    rows that repeat and null ids are rows like others; other columns stay.  An
    empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or trained())

    def clean(text: str) -> str:
        for start, end, label, _ in reversed(spans(text, held.value)):
            text = f"{text[:start]}[{label}]{text[end:]}"
        return text

    @F.arrow_udf("string")
    def replaced(texts: pa.Array) -> pa.Array:
        column = T.as_large(texts)
        some = may_hold(column)
        return pa.array([None if not known else clean(x) if hit else x for x, hit, known in zip(column.to_pylist(), some, texts.is_valid().to_pylist(), strict=True)], pa.string())

    return docs.withColumn(text_col, replaced(F.col(text_col)))
