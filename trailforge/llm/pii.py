"""Personal data by fixed patterns and a semi-Markov conditional random field.

The field cuts a window of tokens into segments, each an entity of up to MAX_TOKENS tokens or one outside
token, and scores whole spans: shape, digit count, check sums and the words around. The best segmentation
(boundaries and types jointly) comes from a dynamic program over the window. Weights are learned here by
gradient steps on the conditional log-likelihood of generated, labelled lines (fixed seed).

Fixed patterns (email, ip, card, phone) always stay; the field adds spans that touch none of them, of
the same kinds or of kind secret. A line is decoded as a whole. Spans that can't be of any kind are no candidates: one token
without a digit, an @ or a key word in the CONTEXT tokens before it; several tokens with fewer than four digits in all,
no @ and no "at" with a "dot" after it. Neither spans nor their context have a longest length in characters.
Nulls are empty texts; long texts cost time in proportion; repeated rows give repeated results; an empty
table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from functools import cache
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import field, fresh, named, with_columns

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
MAX_TOKENS = 6
CONTEXT = 2
#: The kinds as the field numbers them; 0 is outside.
LABELS = ("O", *KINDS)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long runs without one cost nothing."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in _LOCAL_SET:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---- the field -------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\s]+")
_EDGE = ".,;:!?\"'()[]{}<>"
_KEY = re.compile(r"passw(?:or)?d|pwd|secret|token|api[_-]?key|apikey|bearer", re.I)
#: A name that ends in a key word; credentials are what no prose is about when a sign follows.
_NAMED = re.compile(r"(?:(passw(?:or)?d|pwd|api[_-]?key|apikey)|secret|token|bearer)(?:[_-][\w-]*|s)?\Z", re.I)
_SIGN = re.compile("[=:]")
_CALL = re.compile(r"call|phone|tel|fax|mobile|cell|dial", re.I)
_MAIL = re.compile(r"mail|contact|write|reach", re.I)
_PAY = re.compile(r"card|visa|pay|account|credit", re.I)
_HOST = re.compile(r"\bip\b|host|server|address|addr", re.I)
_CUES = (("key", _KEY), ("call", _CALL), ("mail", _MAIL), ("pay", _PAY), ("host", _HOST))
_SHAPED = {
    "plain_mail": re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+"),
    "spelled_mail": re.compile(r"[\w.%+-]++(?: ?[\[(]at[\])] ?| at | ?@ ?)[\w-]++(?:(?: ?[\[(]dot[\])] ?| dot |\.)[\w-]++)+", re.I),
    "quad": re.compile(r"\d{1,3}(?:\.\d{1,3}){3}"),
    "dialled": re.compile(r"\+?[\d(][\d ().-]*\d"),
    "grouped": re.compile(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}"),
    "fours": re.compile(r"\d{4}(?:[ -]?\d{4}){2,3}(?:[ -]?\d{1,4})?"),
    "hex": re.compile(r"[0-9a-f]{12,}"),
    "opaque": re.compile(r"(?=\S*\d)(?=\S*[A-Za-z])[\w+/=-]{10,}"),
    "number": re.compile(r"\d+"),
}


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Tokens without the punctuation at their edges; one that assigns to a key word is cut after the sign."""
    out = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        key = _KEY.search(text, a, b) if "=" in m[0] or ":" in m[0] else None
        sign = _SIGN.search(text, key.end(), b - 1) if key else None
        for x, y in [(a, sign.start()), (sign.end(), b)] if sign else [(a, b)]:
            while x < y and text[x] in _EDGE and text[x] != "(":
                x += 1
            while y > x and text[y - 1] in _EDGE:
                y -= 1
            if x < y:
                out.append((x, y))
    return out


def _given(before: str) -> str | None:
    """What gives the next token a value, if a key word and a sign do: "named" for names of credentials, else "key", and the sign."""
    s = before.rstrip("\"'([").rstrip()
    s = s[:-1] if s[-2:] in ("=>", ":>") else s
    if not s or s[-1] not in "=:":
        return None
    sign, s = s[-1], s[:-1].rstrip()
    if s[-2:].lower() == "is" and s[-3:-2].isspace():
        s = s[:-2].rstrip()
    s = s.rstrip("\"')]")
    k = len(s)
    while k and (s[k - 1].isalnum() or s[k - 1] in "_-"):
        k -= 1
    m = _NAMED.search(s, k)
    return m and ("named" if m[1] else "key") + sign


def context(text: str, tokens: list[tuple[int, int]], i: int) -> tuple[str | None, list[str]]:
    """Of the CONTEXT tokens before token i: what gives it a value, and the features of key words."""
    before = text[tokens[max(0, i - CONTEXT)][0] : tokens[i][0]]
    return _given(before), [f"before_{n}" for n, p in _CUES if p.search(before)]


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int, near: tuple[str | None, list[str]]) -> list[str]:
    """Of the whole span of tokens i to j - 1, near being the context of token i."""
    s = text[tokens[i][0] : tokens[j - 1][1]]
    d = _digits(s)
    out = ["bias", f"tokens{j - i}", f"digits{min(len(d), 20)}"]
    out += [name for name, p in _SHAPED.items() if p.fullmatch(s)]
    letters = sum(map(str.isalpha, s))
    out.append("letters0" if not letters else "letters1" if letters * 2 < len(s) else "letters2")
    if s[0] == "+":
        out.append("plus")
    if "@" in s:
        out.append("at")
    if 13 <= len(d) <= 19 and not letters:
        out.append("luhn" if luhn(d) else "no_luhn")
    word = s.isalpha() and len(s) <= 15 and (s.islower() or s.istitle() or s.isupper())
    given, cues = near
    if given:
        out.append("given_" + "word_" * word + given)
    elif word:
        out.append("word")
    return out + cues


def _candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(end, start) of the spans that may be entities, sorted."""
    digits, mail, at, dot, key = [0], [0], [0], [], -CONTEXT - 1
    out, seeds = set(), []
    for k, (a, b) in enumerate(tokens):
        t = text[a:b]
        n = sum(map(str.isdigit, t))
        bare = t.strip("()[]").lower() if len(t) < 8 else ""
        digits.append(digits[-1] + n)
        mail.append(mail[-1] + ("@" in t))
        at.append(at[-1] + (bare == "at"))
        if bare == "dot":
            dot.append(k)
        if n or "@" in t:
            seeds.append(k)
        if (n or "@" in t or k - key <= CONTEXT) and any(map(str.isalnum, t)):
            out.add((k + 1, k))
        if _KEY.search(t):
            key = k
    for k in seeds:
        for i in range(max(0, k - MAX_TOKENS + 1), k + 1):
            for j in range(max(k, i + 1) + 1, min(len(tokens), i + MAX_TOKENS) + 1):
                if digits[j] - digits[i] >= 4 or mail[j] > mail[i]:
                    out.add((j, i))
    for k in dot:  # spelled addresses hold "at" and "dot" and have tokens on both sides
        for i in range(max(0, k - MAX_TOKENS + 2), k - 1):
            if at[k] > at[i + 1]:
                out.update((j, i) for j in range(k + 2, min(len(tokens), i + MAX_TOKENS) + 1))
    return sorted(out)


def _lattice(text: str, tokens: list[tuple[int, int]]) -> dict[int, list[tuple[int, list[str]]]]:
    """end -> [(start, features)] of the spans that may be entities."""
    out: dict[int, list] = defaultdict(list)
    near: dict[int, tuple] = {}
    for j, i in _candidates(text, tokens):
        if i not in near:
            near[i] = context(text, tokens, i)
        out[j].append((i, features(text, tokens, i, j, near[i])))
    return out


def _scores(w: dict, spans: dict) -> dict[int, list[tuple[int, int, float]]]:
    return {j: [(i, y, sum(w.get((y, f), 0.0) for f in fs)) for i, fs in group for y in range(1, len(LABELS))] for j, group in spans.items()}


def decode(text: str, tokens: list[tuple[int, int]], w: dict) -> list[tuple[int, int, str]]:
    """The best segmentation's entities; outside tokens score 0; ties go to fewer entities, then to the first found."""
    arcs = _scores(w, _lattice(text, tokens))
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i, y, s in arcs.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, y)
    out, j = [], len(tokens)
    while j:
        if back[j]:
            i, y = back[j]
            out.append((tokens[i][0], tokens[j - 1][1], LABELS[y]))
            j = i
        else:
            j -= 1
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def gradient(text: str, gold: list[tuple[int, int, str]], w: dict) -> tuple[float, dict]:
    """Log-likelihood of a labelled line and its gradient, by forward and backward sums over segmentations."""
    tokens = tokens_of(text)
    spans = _lattice(text, tokens)
    arcs, n = _scores(w, spans), len(tokens)
    alpha, beta = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    alpha[0] = beta[n] = 0.0
    for j in range(1, n + 1):
        alpha[j] = alpha[j - 1]
        for i, _, s in arcs.get(j, ()):
            alpha[j] = _log_add(alpha[j], alpha[i] + s)
    for j in range(n, 0, -1):
        beta[j - 1] = _log_add(beta[j - 1], beta[j])
        for i, _, s in arcs.get(j, ()):
            beta[i] = _log_add(beta[i], s + beta[j])
    g: dict = defaultdict(float)
    total = 0.0
    want = {(a, b): LABELS.index(k) for a, b, k in gold}
    for j, group in spans.items():
        by = iter(arcs[j])
        for i, fs in group:
            true = want.get((tokens[i][0], tokens[j - 1][1]), 0)
            for _ in LABELS[1:]:
                _, y, s = next(by)
                p = math.exp(min(0.0, alpha[i] + s + beta[j] - alpha[n]))
                total += s * (y == true)
                if (d := (y == true) - p) and abs(d) > 1e-6:
                    for f in fs:
                        g[y, f] += d
    return total - alpha[n], g


def _line(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A made-up line with labelled entities and look-alikes."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = rng.choice("3456") + num(rng.choice((13, 14, 14, 14, 15)) - 0)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(("", "", " ", "-", " "))
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4)) if sep else d

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"{a} {b} {c}"))

    def mail() -> str:
        u, d = rng.choice((word(), f"{word()}.{num(2)}")), f"mail{num(1)}.example" if rng.random() < 0.3 else word()
        return rng.choice((f"{u}@{d}.com", f"{u}@{d}.org", f"{u} at {d} dot com", f"{u} (at) {d} (dot) org", f"{u} [at] {d} [dot] net"))

    def drawn(n: int) -> str:
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    def letters(n: int) -> str:
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def chosen() -> str:
        """What people choose: up to three digits and often no more than a word."""
        return rng.choice((f"{word()}-{word()}", f"{word()}{num(rng.randint(1, 3))}", f"{word().title()}_{num(2)}", f"{word()}#{word()}{num(1)}", f"{word()}.{word()}", word(), word(), drawn(8)))

    def told() -> str:
        """Prose about key words: no value follows."""
        key = rng.choice(("password", "secret", "token", "bearer", "passwords", "secretary", "tokens", "api key"))
        prose = rng.choice(("secret", "token", "Secret", "Token", "bearer", "tokens"))
        return rng.choice((f"{key} {word()} {word()}", f"{key} {word()}", f"{key} {word()}-{word()}", f"{key}, {word()} {num(1)}", f"{prose}: {word()} {word()}", f"{prose}: {word().title()}", f"{key} {num(1)} {word()}"))

    makers = {
        "email": (mail, ("", "mail", "contact", "reach me:", "write to")),
        "ip": (lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), ("", "host", "server", "from")),
        "card": (card, ("", "card", "visa", "pay with")),
        "phone": (phone, ("", "call", "phone:", "tel", "dial")),
        "secret": (lambda: rng.choice(("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((16, 18, 32, 40)))), word() + num(3) + word() + num(2), drawn(rng.randint(16, 40)), drawn(20).upper(), letters(rng.randint(12, 30)))), ("password=", "token = ", "api_key: ", "secret ", "Bearer ", '"token": ', "pwd=", "client_secret=", "token:", '"api_key":"', "Authorization: Bearer ")),
    }
    near = (lambda: num(rng.choice((4, 4, 5, 6, 12))), lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{num(1)}.{num(2)}", lambda: f"{rng.randint(1900, 2030)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{word()} at {word()}", lambda: f"v{num(1)}.{num(1)}.{num(1)}", lambda: f"{word()}{num(4)}", lambda: f"@{word()}", lambda: f"{num(3)}, {num(3)}, {num(3)}", lambda: f"{num(4)} {word()} {num(4)}", lambda: f"{num(1)},{num(3)},{num(3)}", lambda: "".join(rng.choice("0123456789") for _ in range(16)), lambda: f"{word()}-{num(2)}-{word()}", lambda: f"{word()}/{word()}{num(1)}", told, told, told, told)
    text, gold = "", []
    for _ in range(rng.randint(1, 3)):
        text += "".join(word() + " " for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.45:
            text += rng.choice(near)() + " "
            continue
        kind = rng.choice(KINDS)
        make, cues = makers[kind]
        cue = rng.choice(cues)
        if kind == "secret" and rng.random() < 0.4:
            cue, make = rng.choice(("password=", "password: ", "passwd = ", "pwd: ", "api_key=", "token=", "secret=", '"password": ', "password:", "pwd:")), chosen
        s = make()
        text += cue + (" " if cue and cue[-1] not in "= " and not cue.endswith((":", '"')) else " " if cue in ("reach me:", "phone:") else "")
        quoted = kind == "secret" and rng.random() < 0.4
        text += '"' * quoted
        gold.append((len(text), len(text) + len(s), kind))
        text += s + '"' * quoted + rng.choice((" ", ". ", ", "))
    return text + word(), [(a + (text[a] in _EDGE and text[a] != "("), b, k) for a, b, k in gold]


@cache
def weights(lines: int = 600, passes: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> dict:
    """Learned by AdaGrad on generated lines, the same on every machine."""
    rng = random.Random(seed)
    made = [_line(rng) for _ in range(lines)]
    w: dict = defaultdict(float)
    seen: dict = defaultdict(lambda: 1e-6)
    for _ in range(passes):
        for text, gold in made:
            for k, d in gradient(text, gold, w)[1].items():
                d -= decay * w[k]
                seen[k] += d * d
                w[k] += rate * d / math.sqrt(seen[k])
    return dict(w)


_CUE = re.compile(r"[0-9@]|passw(?:or)?d|pwd|secret|token|api[_-]?key|apikey|bearer|(?<!\w)dot(?!\w)", re.I)


def field_spans(text: str, w: dict) -> list[tuple[str, int, int]]:
    """What the field finds in a text, line by line: spans stay on a line."""
    out = []
    for m in re.finditer(r"[^\n]+", text):
        a, b = m.span()
        if _CUE.search(text, a, b):
            out += [(kind, a + x, a + y) for x, y, kind in decode(m[0], tokens_of(m[0]), w)]
    return out


def find(text: str | None, w: dict) -> tuple[list, list]:
    """Base spans, and all spans: the field's where they touch no span that is there already."""
    text = text or ""
    base = base_spans(text)
    spans = list(base)
    if _CUE.search(text):
        taken = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in taken]
        reach = list(accumulate((b for _, b in taken), max))  # the furthest end of the spans up to here
        last = 0
        for kind, a, b in field_spans(text, w):
            k = bisect_left(starts, b)
            if a >= last and not (k and reach[k - 1] > a):
                spans.append((kind, a, b))
                last = b
    return base, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones together, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, the digest of base spans, and all spans."""
    w = weights()

    def run(_, texts):
        rows = []
        for text in texts.to_pylist():
            base, spans = find(text, w)
            rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return list(zip(*rows, strict=True)) or [[]] * 6

    fields = [*(field(f"n_{k}", "long") for k in BASE), field("base_sha256", "string"), field("spans", "string")]
    return with_columns(docs.select("doc_id", "text"), run, ["doc_id", "text"], fields).drop("text")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text, and n_chars, where there is one, counted anew. A null text stays null."""
    from pyspark.sql import functions as F

    w = weights()

    def run(texts):
        return [[t if t is None else redact(t, find(t, w)[1]) for t in texts.to_pylist()]]

    (name,) = fresh(docs, "redacted")
    out = with_columns(docs, run, ["text"], [field(name, "string")])
    changed = {"text": named(name), "n_chars": F.length(named(name)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*(changed[c].alias(c) if c in changed else named(c) for c in docs.columns))
