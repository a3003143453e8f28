"""Plain-Python versions of the fixed parts of the contracts."""

import hashlib
import re


def sha(x):
    return hashlib.sha256(",".join(x).encode()).hexdigest()


def secrets(text):
    """Base spans (start, kind index, end)."""
    text = text or ""
    out = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, (rx, ok) in enumerate(
        [(assign, lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    ):
        out += [(m.start(), k, m.end()) for m in rx.finditer(text) if ok(m)]
    return sorted(out)


def secrets_row(text):
    x = secrets(text)
    n = [sum(k == i for _, k, _ in x) for i in range(3)]
    return (*n, sha([f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in x]))


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (rx, ok) in enumerate(kinds) for m in re.finditer(rx, text) if ok(m[0])]


def pii_row(text):
    x = pii(text)
    n = [sum(k == i for k, _, _ in x) for i in range(4)]
    return (*n, sha([f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for k, s, e in x]))
