"""Personal data: exact patterns, and a semi-Markov conditional random field that adds what they miss.

The field labels segments, not tokens: a candidate span has features of its whole (digits, their grouping, check sum,
word before, ...), and a dynamic program over the tokens picks boundaries and kinds together; an entity has at most
MAX_TOKENS tokens. Weights are fitted here by conditional likelihood on lines made by a seeded generator. An entity
needs a digit run, a spelt-out "at", or a value assigned to a name of a credential, so only the stretches around those are
decoded: elsewhere every path is the empty one. What the patterns found is clamped, and the field decides between them.

Beside the four kinds of the patterns the field knows ``secret``: passwords, access keys and tokens.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import over_arrow, quoted

#: Kinds of the patterns, and those of the field.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
Span = tuple[str, int, int]

# ---------------------------------------------------------------- patterns

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The look-behind changes no match (one can't begin inside a run of digits) and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns: leftmost, non-overlapping within a kind, failing ones dropped without a retry."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


# ---------------------------------------------------------------- candidate spans

_DIGIT = re.compile("[0-9]")
#: Stretches that an entity can lie in: digits with separators, colon-separated hex, and a spelt-out address.
_STRETCH = re.compile(
    r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])"
    r"|[(+]?[0-9](?:[\x20().+/-]{0,3}[0-9])+"
)
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20{0,2}[(\[{]\x20?(?:at|AT)\x20?[)\]}]\x20{0,2}[A-Za-z0-9-]{1,63}(?:(?:\.|\x20{0,2}[(\[{]\x20?(?:dot|DOT)\x20?[)\]}]\x20{0,2})[A-Za-z0-9-]{1,63}){1,5}")
#: A colon-separated hex group is one token, as its digits and letters are no entity's boundary.
_TOKEN = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{1,4}(?=:)|(?<=:)[0-9A-Fa-f]{1,4}(?![0-9A-Za-z])|[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]")
#: A run that holds a digit; the look-behind and the possessive parts let every run be tried once. Then a value behind a credential's name.
_RUN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z_+/=-]*+[0-9][A-Za-z0-9_+/=-]*+")
_NAMED = re.compile(r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|credential)s?[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?([^\s\"',;]{6,128})")
_NAME_BEFORE = re.compile(r"(?i)(passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|credential)s?[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?$")
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|pk_|xox[abp]-|AIza|eyJ|glpat-")
#: Pieces of a run without blanks: letters and digits of a secret are no boundary.
_PIECE = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}$")
#: Tokens of an entity, and digit groups of one that is neither spelt out nor colon-separated: a full IPv6 address has 15
#: tokens, 00 and 15 digits in pairs after a code of one digit have 9 groups and 17 tokens with single separators, up to
#: 33 with separators of three. A spelt-out address may be longer; its whole stretch is proposed as well.
MAX_TOKENS, MAX_GROUPS = 40, 10
_CUES = {w: k for k, ws in {"phone": ("tel", "phone", "call", "mobile", "fax", "cell"), "card": ("card", "visa", "credit", "mastercard"), "ip": ("ip", "host", "server", "ipv"), "email": ("mail", "email", "contact", "write")}.items() for w in ws}
_TLD = frozenset(("com", "net", "org", "edu", "gov", "io", "de", "fr", "es", "uk", "info"))
_SHAPE = re.compile(r"[0-9]+")


def features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole span."""
    s = text[start:end]
    digits = "".join(_SHAPE.findall(s))
    n = len(digits)
    if len(s) >= 6 and (letters := sum(c.isalpha() for c in s)) and ":" not in s:
        lower, upper = any(c.islower() for c in s), any(c.isupper() for c in s)
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
        hexes = all(c in "0123456789abcdefABCDEF" for c in s)
        named = bool(_NAME_BEFORE.search(text[max(0, start - 32) : start]))
        mixed = "hex" if hexes else f"{'a' * lower}{'A' * upper}{'1' * (n > 0)}"
        out = ["bias", f"run {mixed} {'named' if named else 'bare'}", f"run {min(len(s) // 4, 12)}", f"changes {min(8 * changes // len(s), 5)}", f"letters {min(8 * letters // len(s), 7)}"]
        out += ["named"] * named + ["prefix " + ("named" if named else "bare")] * bool(_PREFIX.match(s)) + ["slashes"] * (s.count("/") > 1) + ["dashes"] * (s.count("-") > 1)
        if start and (text[start - 1].isalnum() or text[start - 1] in "_+/=-@."):
            out.append("joined left")
        if end < len(text) and (text[end].isalnum() or text[end] in "_+/=-@"):
            out.append("joined right")
        if not re.search(r"(?i)[(\[{]\x20?at\x20?[)\]}]", s):
            return out
    shape = _SHAPE.sub(lambda m: str(len(m[0])), s)
    out = ["bias", f"n{n if n < 20 else 20}"]
    if s.isascii() and not any(c.isalpha() for c in s):
        out.append(f"shape {shape if len(shape) < 20 else 'long'}")
        out.append("groups " + ",".join(str(len(g)) for g in _SHAPE.findall(s)) if len(s) < 32 else "groups long")
        for mark, name in (("(", "paren"), ("/", "slash"), (".", "dot"), ("-", "dash"), (" ", "space"), ("+", "plus")):
            if mark in s:
                out.append(name)
    if re.match(r"00[0-9\x20().-]", s):
        out.append("prefix 00")
    if 13 <= n <= 19:
        out.append(f"luhn {luhn(digits)}")
    if s.count(":") >= 2:
        parts = s.split(":")
        out.append(f"colons {min(s.count(':'), 8)}")
        out.append(f"hex {any(c.isalpha() for c in s)} full {len(parts) == 8 and all(parts)} short {s.count('::') == 1}")
    low = s.lower()
    if "at" in low and any(c in "([{" for c in s):
        tail = re.findall("[a-z]+", low)
        out.append(f"spelt tld {bool(tail) and tail[-1] in _TLD} dots {min(low.count('dot') + s.count('.'), 3) > 0}")
    m = _BEFORE.search(text[max(0, start - 24) : start])
    out.append(f"cue {_CUES.get(m[1].lower(), 'none') if m else 'none'}")
    if start and (text[start - 1].isalnum() or text[start - 1] in "$€£#.,_"):
        out.append("joined left")
    if end < len(text) and (text[end].isalnum() or text[end] in "%_" or (text[end] in ".,:-/" and end + 1 < len(text) and text[end + 1].isalnum())):
        out.append("joined right")
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    found = []
    if _DIGIT.search(text) or "::" in text:
        found += [m.span() for m in _STRETCH.finditer(text) if m.end() - m.start() >= 6]
    low_at = "at)" in text or "at]" in text or "at}" in text or "AT" in text or "at )" in text or "at ]" in text or "at }" in text
    if low_at:
        found += [m.span() for m in _SPELT.finditer(text)]
    if _DIGIT.search(text):
        found += [m.span() for m in _RUN.finditer(text) if m.end() - m.start() >= 8 and any(c.isalpha() for c in m[0])]
    if "=" in text or ":" in text:
        found += [m.span(1) for m in _NAMED.finditer(text)]
    return sorted(set(found))


def segments(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[list[tuple[int, list[str]]]]]:
    """Tokens of a stretch, and for each token the candidate spans that begin with it: (tokens, features)."""
    whole = text[start:end]
    secret = not any(c in whole for c in " \t\n([{:") and any(c.isalpha() for c in whole)
    tokens = [m.span() for m in (_PIECE if secret else _TOKEN).finditer(text, start, end)]
    spelt = any(text[a:b] in ("at", "AT") for a, b in tokens)
    numbers = [sum("0" <= c <= "9" for c in text[a:b]) for a, b in tokens]
    out: list[list[tuple[int, list[str]]]] = []
    for i, (a, _) in enumerate(tokens):
        mine, n, groups = [], 0, 0
        if text[a].isalnum() or text[a] in "(+:":
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                n, groups = n + numbers[j], groups + (numbers[j] > 0)
                b = tokens[j][1]
                if not (text[b - 1].isalnum() or text[b - 1] == ":" or (secret and text[b - 1] == "=")):
                    continue
                if n > 32 and not secret:
                    break
                if secret and b - a >= 6:
                    mine.append((j - i + 1, features(text, a, b)))
                    continue
                if (7 <= n <= 19 and groups <= MAX_GROUPS) or (spelt and any(text[x:y] in ("at", "AT") for x, y in tokens[i : j + 1])) or text.count(":", a, b) >= 2:
                    mine.append((j - i + 1, features(text, a, b)))
            if (spelt or secret) and i == 0 and len(tokens) > MAX_TOKENS:
                mine.append((len(tokens), features(text, a, tokens[-1][1])))
        out.append(mine)
    return tokens, out


# ---------------------------------------------------------------- semi-Markov field


def _scores(candidates: list[list[tuple[int, list[str]]]], weights: dict) -> list[list[tuple[int, int, float]]]:
    """(tokens, kind, score) of the segments that begin at each token; the empty segment of one token scores 0."""
    out = []
    for mine in candidates:
        row = []
        for length, feats in mine:
            for y, kind in enumerate(KINDS):
                row.append((length, y, sum(weights.get((kind, f), 0.0) for f in feats)))
        out.append(row)
    return out


def viterbi(candidates: list[list[tuple[int, list[str]]]], weights: dict) -> list[tuple[int, int, int]]:
    """The best segmentation: (first token, end token, kind) of its entities. Ties take the empty segment, then the shorter and earlier kind."""
    n, scored = len(candidates), _scores(candidates, weights)
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    for i in range(n):
        if best[i] > best[i + 1] or back[i + 1] is None and best[i + 1] == -math.inf:
            best[i + 1], back[i + 1] = best[i], None
        for length, y, s in scored[i]:
            if best[i] + s > best[i + length]:
                best[i + length], back[i + length] = best[i] + s, (i, i + length, y)
    out, at = [], n
    while at:
        if back[at] is None:
            at -= 1
        else:
            out.append(back[at])
            at = back[at][0]
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def gradient(candidates: list[list[tuple[int, list[str]]]], gold: set[tuple[int, int, int]], weights: dict) -> dict:
    """Of the log likelihood of the gold segmentation: its features less their expectation (forward-backward over segments)."""
    n, scored = len(candidates), _scores(candidates, weights)
    alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i in range(n):
        alpha[i + 1] = _log_add(alpha[i + 1], alpha[i])
        for length, _, s in scored[i]:
            alpha[i + length] = _log_add(alpha[i + length], alpha[i] + s)
    for i in reversed(range(n)):
        beta[i] = beta[i + 1]
        for length, _, s in scored[i]:
            beta[i] = _log_add(beta[i], beta[i + length] + s)
    out: dict = defaultdict(float)
    for i in range(n):
        k = 0
        for length, feats in candidates[i]:
            for y, kind in enumerate(KINDS):
                s = scored[i][k][2]
                k += 1
                p = math.exp(alpha[i] + s + beta[i + length] - alpha[n])
                d = ((i, i + length, y) in gold) - p
                if abs(d) > 1e-6:
                    for f in feats:
                        out[(kind, f)] += d
    return out


# ---------------------------------------------------------------- training lines


def _made(rng: random.Random) -> tuple[str, list[Span]]:
    """A line with at most one entity among things that look like one."""
    word = lambda: "".join(rng.choice(["th", "er", "an", "in", "ou", "ion", "es", "ch"]) for _ in range(rng.randint(1, 4)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    kind = rng.choice([*BASE_KINDS, *["none"] * 5])
    cue = ""
    if kind == "phone":
        area, a, b = rng.choice("23456789") + num(2), num(3), num(4)
        body = rng.choice([f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"({area}) {a} {b}", f"00{rng.randint(1, 99)} {area} {a} {b}"])
        cue = rng.choice(["", "", "call ", "tel ", "phone: ", "mobile "])
    elif kind == "card":
        digits = rng.choice("3456") + num(14)
        digits += next(d for d in "0123456789" if luhn(digits + d))
        body = rng.choice([".", "/", " - ", "  "]).join(digits[k : k + 4] for k in (0, 4, 8, 12))
        cue = rng.choice(["", "card ", "visa "])
    elif kind == "ip":
        hexes = [f"{rng.randint(0, 65535):x}" for _ in range(8)]
        body = rng.choice([":".join(hexes), ":".join(hexes[:3]) + "::" + ":".join(hexes[5:7]), "fe80::" + ":".join(hexes[4:])])
        cue = rng.choice(["", "ip ", "host "])
    elif kind == "email":
        at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "."), ("{at}", "{dot}"), ("(AT)", "(DOT)")])
        gap = rng.choice(["", " "])
        body = f"{word()}{rng.choice(['', '.' + word(), num(2)])}{gap}{at}{gap}{word()}{gap if dot != '.' else ''}{dot}{gap if dot != '.' else ''}{rng.choice(sorted(_TLD))}"
        cue = rng.choice(["", "mail ", "contact "])
    else:
        sixteen = num(16)
        body = rng.choice([
            f"{rng.randint(1900, 2099)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1900, 2099)}", f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/{rng.randint(1900, 2099)}",
            f"{num(1)}.{num(2)}.{num(1)}", num(7), num(8), num(9), num(10), num(12), f"${num(3)}.{num(3)}.{num(2)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
            sixteen[:-1] + str((int(sixteen[-1]) + 1) % 10) if luhn(sixteen) else sixteen, f"{num(2)}:{num(2)}:{num(2)}", f"{num(2)}:{num(2)}:{num(2)}.{num(3)}", " ".join(num(rng.randint(1, 2)) for _ in range(rng.randint(6, 9))), " ".join(num(4) for _ in range(rng.choice([2, 3, 5, 6]))),
            f"{num(4)}/{num(5)}", f"{num(3)} {num(3)}", f"{num(2)} 000 000 000", f"{word()} (at) {word()}", f"{num(3)}-{num(2)}-{num(4)}", f"{num(5)}-{num(5)}", f"{num(3)}.{num(3)}.{num(3)}.{num(3)}.{num(2)}", " ".join(num(3) for _ in range(rng.randint(4, 7))),
        ])
        cue = rng.choice(["", "", "", "on ", "no. ", "id "])
    head = f"{word()} {word()} {cue}" if rng.random() < 0.8 else cue
    line = f"{head}{body}{rng.choice(['', '.', ',', ' ' + word()])} {word()}"
    return line, [(kind, len(head), len(head) + len(body))] if kind != "none" else []


def _made_abroad(rng: random.Random) -> tuple[str, list[Span]]:
    """A line with a number of the prefix 00 in groups as they are written abroad."""
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    code = rng.choice([rng.choice("17"), str(rng.randint(20, 99)), str(rng.randint(200, 999))])
    sizes = rng.choice([(1, 2, 2, 2, 2), (2, 2, 2, 2, 2), (3, 3, 4), (2, 3, 2, 2), (2, 4, 4), (3, 2, 2, 2), (1, 2, 2, 2, 2, 2), (2, 2, 2, 2, 2, 2)])
    gap = rng.choice([" ", " ", " ", "-", "."])
    body = gap.join([rng.choice(["00", "00", "00" + code]), code, *map(num, sizes)])
    if body.startswith("00" + code):
        body = gap.join(["00" + code, *map(num, sizes)])
    head = rng.choice(["", "call ", "tel ", "phone: ", "mobile ", "ththes ", "eran ioner "])
    return f"{head}{body}{rng.choice(['', '.', ',', ' ther'])} ining", [("phone", len(head), len(head) + len(body))]


def _made_secret(rng: random.Random) -> tuple[str, list[Span]]:
    """A line with a credential, or with a run that looks like one: an id, a path, a word with a number, a check sum."""
    of = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    hexes, upper, lower = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz"
    every = lower + lower.upper() + "0123456789"
    word = lambda: "".join(rng.choice(["th", "er", "an", "in", "ou", "ion", "es", "ch"]) for _ in range(rng.randint(2, 5)))
    name = rng.choice(["password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "client_secret", "auth_token"])
    name = rng.choice([name, name.upper(), name.capitalize()])
    sign = rng.choice(["=", ": ", " = ", ":", '="', ': "', " = '"])
    close = sign[-1] if sign[-1] in "\"'" else ""
    kind = rng.choice(["named", "named", "prefixed", "none", "none"])
    if kind == "named":
        body, head = rng.choice([of(hexes, rng.choice([16, 18, 24, 32, 40, 64])), of(every, rng.randint(8, 40)), word() + of("0123456789", rng.randint(1, 4)), of(every, 10) + "/" + of(every, 12) + "+" + of(every, 8) + "="]), name + sign
    elif kind == "prefixed":
        body, head = rng.choice(["AKIA" + of(upper, 16), "ASIA" + of(upper, 16), "ghp_" + of(every, 36), "sk-" + of(every, rng.randint(24, 48)), "AIza" + of(every, 35), "xoxb-" + of("0123456789", 12) + "-" + of(every, 24), "glpat-" + of(every, 20)]), rng.choice(["", "", "key ", name + sign])
    else:
        body = rng.choice([
            of(hexes, 40), of(hexes, 64), of(hexes, 7) + of("0123456789", 3), word() + of("0123456789", rng.randint(2, 6)), of("0123456789", 4) + word(), f"{of(hexes, 8)}-{of(hexes, 4)}-{of(hexes, 4)}-{of(hexes, 4)}-{of(hexes, 12)}",
            f"{word()}/{word()}/{of('0123456789', 4)}/{word()}", f"{word()}-{word()}-{of('0123456789', 3)}", f"{of(upper, 3)}-{of('0123456789', 6)}", f"{word()}_{word()}_{rng.randint(1, 99)}", f"{of('0123456789', 3)}x{of('0123456789', 4)}", word().upper() + of("0123456789", 4), of(every, 12), of(upper, 10) + of("0123456789", 4),
        ])
        head, close = rng.choice(["", "", "", "commit ", "id=", "sha256:", "version ", "http://ththes.example/", "see ", "no. ", "page=", "ref: "]), ""
    lead = f"{word()} {word()} " if rng.random() < 0.8 else ""
    if kind == "prefixed" and not head.endswith(sign):
        close = ""
    line = f"{lead}{head}{body}{close}{rng.choice(['', '.', ',', ' ' + word()])} {word()}"
    at = len(lead) + len(head)
    return line, [("secret", at, at + len(body))] if kind != "none" else []


#: Size of the made training set, passes over it, step and decay of the fit; the penalty of adding a span at decoding.
LINES, PASSES, RATE, DECAY, CAUTION = 1500, 6, 0.25, 1e-4, 2.0


def examples(seed: int, lines: int) -> Iterator[tuple[str, list[Span]]]:
    rng = random.Random(seed)
    for _ in range(lines):
        yield _made(rng)


@functools.lru_cache(maxsize=1)
def trained() -> dict:
    """Weights by stochastic gradient ascent of the conditional log likelihood; the same in every run."""
    data, rng = [], random.Random(8)
    lines = [x for k, line in enumerate(examples(7, LINES)) for x in ([line, _made_abroad(rng)] if k % 4 == 0 else [line, _made_secret(rng)])]
    for line, gold in lines:
        for a, b in stretches(line):
            tokens, candidates = segments(line, a, b)
            starts, ends = {t[0]: k for k, t in enumerate(tokens)}, {t[1]: k + 1 for k, t in enumerate(tokens)}
            known = {(starts[s], ends[e], KINDS.index(k)) for k, s, e in gold if s in starts and e in ends}
            if any(candidates):
                data.append((candidates, known))
    weights: dict = defaultdict(float)
    for k in range(PASSES):
        rate = RATE / (1 + k)
        for candidates, known in data:
            for f, g in gradient(candidates, known, weights).items():
                weights[f] += rate * (g - DECAY * weights[f])
    for kind in KINDS:
        weights[(kind, "bias")] -= CAUTION
    return dict(weights)


def added_spans(text: str, base: list[Span], weights: dict) -> list[Span]:
    """What the field finds outside the clamped base spans; linear in the spans but for searches of their sorted places."""
    out: list[Span] = []
    found: list[tuple[int, int]] = []
    clamped: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if clamped and a < clamped[-1][1]:
            clamped[-1][1] = max(clamped[-1][1], b)
        else:
            clamped.append([a, b])
    ends = [b for _, b in clamped]
    for a, b in stretches(text):
        # decode between the clamped spans
        pieces, at = [], a
        for x, y in clamped[bisect.bisect_right(ends, a) :]:
            if x >= b:
                break
            if at < x:
                pieces.append((at, x))
            at = max(at, y)
        if at < b:
            pieces.append((at, b))
        for x, y in pieces:
            if y - x < 6:
                continue
            tokens, candidates = segments(text, x, y)
            if any(candidates):
                for i, j, kind in viterbi(candidates, weights):
                    s, e = tokens[i][0], tokens[j - 1][1]
                    k = bisect.bisect_left(found, (s, e))
                    if (k == 0 or found[k - 1][1] <= s) and (k == len(found) or e <= found[k][0]):
                        found.insert(k, (s, e))
                        out.append((KINDS[kind], s, e))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def personal_data(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, counts and SHA-256 of the pattern spans, and all spans (``kind:start:end`` in code points, end exclusive).

    n_email to n_phone are the patterns' counts, n_added counts the field's spans, n_spans all. Null texts count as empty (no
    spans); repeated rows and null ids stay; other columns are not read; an empty table gives an empty result. Nothing is
    shuffled.

    The field scores no candidate beyond these bounds: MAX_TOKENS tokens (a longer run or spelt-out address only as a whole),
    MAX_GROUPS groups and 7 to 19 digits of a number, at least six characters, 128 of a named value that has no digit, 64 of
    a spelt-out local part, 63 of a label and six labels. The patterns have no bounds.
    """
    weights = trained()
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE_KINDS}
            digests, spans, extra, every = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, weights)
                for k in BASE_KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
                extra.append(len(more))
                every.append(len(base) + len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64()), pa.array(every, pa.int64())],
                [id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added", "n_spans"],
            )

    return over_arrow(df.select(F.col(quoted(id_col)), F.col(quoted(text_col))), run, schema)
