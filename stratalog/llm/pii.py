"""Personal data in texts: fixed base patterns, and candidates that boosted trees accept.

Base spans (email, ip, card, phone) are decided by their patterns alone. Further candidates come from high-recall generators
that may overlap: written-out addresses, long digit groups, key-value secrets and long random-looking strings. Each
candidate is described by its format and by the words around it; gradient-boosted trees, fitted on generated labelled
sentences, score it, and a calibrated threshold for each kind selects it. Of overlapping added spans the most probable stays.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm import common
from stratalog.llm.boosting import Boosted

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "secret", "address_words", "national_id", "phone_local", "iban")
ORDER = {kind: k for k, kind in enumerate((*BASE, *ADDED))}

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by start, then kind. Kinds may overlap each other."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_SET:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


#: High-recall generators by kind.
_GENERATORS = {
    "account": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){9,25}(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}"),
    "address_words": re.compile(r"[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,64}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{2,32}){1,4}"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "phone_local": re.compile(r"(?<![0-9+.])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9.]?[0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
}
_CUES = {
    "secret_cue": re.compile(r"(?:token|secret|passw|pwd|api.?key|key|auth|bearer|credential)[\w\"' ]{0,12}[:=]?[\"' ]*\Z", re.I),
    "money_cue": re.compile(r"(?:card|account|konto|iban|cuenta|compte|visa|pay)[\w ]{0,12}[:#=]? *\Z", re.I),
    "person_cue": re.compile(r"(?:ssn|social|tax|passport|id|phone|tel|call|fax|mobile|contact|mail)[\w .]{0,12}[:#=]? *\Z", re.I),
    "number_cue": re.compile(r"(?:version|order|invoice|isbn|doi|total|page|no|sum|year|figure|build|commit|sha|hash|http\S*|www\S*)[\w .]{0,8}[:#=/]* *\Z", re.I),
}

_LETTER = re.compile(r"[A-Za-z]")


def _mixed(run: str) -> bool:
    """Whether a run of any length has a digit and a letter."""
    return _DIGIT.search(run) is not None and _LETTER.search(run) is not None


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans of all generators, in order; a generator is tried only where a cheap test shows that it can match."""
    lowered_dot = " dot " in text or "dot)" in text or "dot]" in text or "dot}" in text
    digits = _DIGIT.search(text) is not None
    return [(kind, m.start(), m.end()) for kind, pattern in _GENERATORS.items() if (lowered_dot if kind == "address_words" else digits) for m in pattern.finditer(text) if kind != "secret" or _mixed(m[0])]


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 32) : a], text[b : b + 8]
    digits, upper, letters = sum(map(str.isdigit, s)), sum(map(str.isupper, s)), sum(map(str.isalpha, s))
    counts = Counter(s)
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts.values())
    runs = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:], strict=False))
    only = "".join(filter(str.isdigit, s))
    hexes = sum(c in "0123456789abcdefABCDEF" for c in s)
    return [
        float(ORDER[kind]), len(s), digits, digits / len(s), upper / len(s), letters / len(s), entropy, len(counts) / len(s), runs / len(s), hexes / len(s),
        s.count("-") + s.count(" "), s.count("/"), s.count("_"), float(len(set(only)) < 3), float(luhn(only)) if only else 0.0,
        float(before[-1:] in "\"'"), float(after[:1] in "\"'" and bool(after)), float(before[-1:] in "=:#"), float(before[-1:] == "/"), float("http" in before or "www." in before),
        *(float(bool(p.search(before))) for p in _CUES.values()),
    ]


def training_spans(seed: int = 7, each: int = 260) -> tuple[np.ndarray, np.ndarray]:
    """Generated labelled sentences: personal data of each added kind, and look-alikes that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("the", "er", "in", "on", "at", "re", "ou", "de", "en", "ich", "la", "que", "ión", "ß")) for _ in range(r.randint(1, 4)))
    plain = lambda: "".join(r.choice(("the", "er", "in", "on", "at", "re", "ou", "de")) for _ in range(r.randint(1, 4)))
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    num, hexa, base = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    group = lambda n, k, sep: sep.join(some(num, k) for _ in range(n))
    good = {
        "account": lambda: (r.choice(("", "card ", "account: ", "")), r.choice((some(num, r.randint(12, 19)), group(4, 4, r.choice(" -")))), ""),
        "secret": lambda: r.choice(((r.choice(('token = "', "api_key='", 'secret: "', 'password="')), some(r.choice((hexa, base)), r.randint(16, 64)), r.choice("\"'")), (r.choice(("Bearer ", "token: ", "key=", "")), r.choice(("ghp_", "sk-", "AKIA", "")) + some(base, r.randint(24, 48)), ""))),
        "address_words": lambda: (r.choice(("mail ", "write to ", "")), r.choice((f"{plain()}.{plain()} at {plain()} dot com", f"{plain()} [at] {plain()} [dot] org", f"{plain()}(at){plain()}(dot){plain()}(dot)net")), ""),
        "national_id": lambda: (r.choice(("SSN ", "id: ", "", "social security ")), f"{some(num, 3)}-{some(num, 2)}-{some(num, 4)}", ""),
        "phone_local": lambda: (r.choice(("call ", "tel. ", "phone: ", "", "")), r.choice((f"({some(num, 3)}) {some(num, 3)}-{some(num, 4)}", f"{some(num, 3)}-{some(num, 3)}-{some(num, 4)}", f"{some(num, 3)}.{some(num, 3)}.{some(num, 4)}")), ""),
        "iban": lambda: (r.choice(("IBAN ", "", "Konto ")), r.choice(("DE", "FR", "ES", "GB")) + some(num, 2) + r.choice(("", " ")) + group(4, 4, r.choice((" ", ""))) + some(num, 2), ""),
    }
    bad = [
        lambda: ("order no ", some(num, r.randint(10, 12)), ""),
        lambda: ("total ", "0" * r.randint(10, 20), ""),
        lambda: ("", group(r.randint(6, 12), 1, " ") + " " + some(num, 2), ""),
        lambda: ("", " ".join(str(r.randint(1990, 2030)) for _ in range(r.randint(3, 5))), ""),
        lambda: ("http://site.example/", "-".join(word() for _ in range(4)) + str(r.randint(1, 99)), ""),
        lambda: ("", "_".join(word() for _ in range(5)) + some(num, 1), ""),
        lambda: ("", "-".join(word() for _ in range(5)) + "-" + str(r.randint(2000, 2030)), ""),
        lambda: ("", "a" * r.randint(15, 40) + "1", ""),
        lambda: ("version ", f"{some(num, 3)} {some(num, 4)} {some(num, 4)}", ""),
        lambda: ("between ", f"{r.randint(100, 2030)} {r.randint(100, 2030)} {r.randint(100, 2030)}", ""),
        lambda: ("", f"{word()}ing at {word()} dot {word()}", ""),
        lambda: ("build ", "".join(word() for _ in range(6)) + some(num, 2), ""),
    ]
    x, y = [], []

    def put(made: tuple[str, str, str], label: int) -> None:
        text = " ".join(word() for _ in range(r.randint(0, 5)))
        text = f"{text} {made[0]}"
        a, b = len(text), len(text) + len(made[1])
        text += made[1] + made[2] + r.choice((" ", ".", ", ")) + word()
        for span in candidates(text):
            if span[1] < b and span[2] > a:
                hit = label and span[1] <= a and span[2] >= b
                x.append(features(text, span))
                y.append(int(hit))

    for _ in range(each):
        for make in good.values():
            put(make(), 1)
        for make in bad:
            put(make(), 0)
    order = np.random.default_rng(seed).permutation(len(y))
    return np.array(x)[order], np.array(y)[order]


@functools.lru_cache(1)
def model() -> tuple[Boosted, dict[str, float]]:
    """The trees, and for each kind the smallest threshold at which what it accepts is 95 percent right.

    Thresholds are chosen on spans that the trees have not seen.
    """
    trees = Boosted().fit(*training_spans())
    x, y = training_spans(seed=8)
    p, cuts = trees.probability(x), {}
    for kind in ADDED:
        own = x[:, 0] == ORDER[kind]
        cuts[kind] = next((float(t) for t in np.arange(0.3, 0.96, 0.05) if (own & (p >= t)).any() and y[own & (p >= t)].mean() >= 0.95), 0.95)
    return trees, cuts


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Accepted candidates that no base span and no more probable candidate overlaps."""
    found = [c for c in candidates(text) if not any(a < c[2] and b > c[1] for _, a, b in base)]
    if not found:
        return []
    trees, cuts = model()
    p = trees.probability(np.array([features(text, c) for c in found]))
    out: list[tuple[str, int, int]] = []
    for k in sorted(range(len(found)), key=lambda k: (-p[k], found[k][1], ORDER[found[k][0]])):
        kind, a, b = found[k]
        if p[k] >= cuts[kind] and not any(x < b and y > a for _, x, y in out):
            out.append(found[k])
    return out


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base), key=lambda s: (s[1], ORDER[s[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, a, b = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < b:
            b = max(b, spans[k][2])
            k += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = True) -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and with ``redacted`` the redacted text.

    Null text counts as empty: no span, the digest of the empty string, redacted null. Ids are only carried, null and repeated
    ones too. Texts are read whole, however long. An empty table gives no row.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            base, spans = all_spans(text or "")
            n = Counter(s[0] for s in base)
            rows.append((*(n[k] for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), *[text if not spans else redact(text, spans)] * redacted))
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string(), pa.string(), *[pa.string()] * redacted), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", *["redacted"] * redacted])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_text(rows, "text", kernel, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * redacted)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows with personal data in the text redacted and, where the text changed, its length set anew; null text stays null.

    Other columns, null and repeated ids too, are carried as they are. An empty table gives no row.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lengths = batch.column(text_col).to_pylist(), batch.column(length_col).to_pylist()
        for k, text in enumerate(texts):
            spans = all_spans(text)[1] if text else []
            if spans:
                texts[k] = redact(text, spans)
                lengths[k] = len(texts[k])
        fresh = {text_col: pa.array(texts, pa.string()), length_col: pa.array(lengths, batch.schema.field(length_col).type)}
        return pa.RecordBatch.from_arrays([fresh.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return common.map_text(docs, text_col, kernel, docs.schema)
