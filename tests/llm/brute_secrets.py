"""Secret scans by plain loops."""

import re
from collections import Counter
from math import log2

from lodegraph.llm.secret_scan import ALLOWED, CLASSES

KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in
                   ("password", "passwd", "secret", "token", "api_?key"))
FORMS = (
    ("assign", re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def entropy(text):
    return -sum(n / len(text) * log2(n / len(text)) for n in Counter(text).values())


def base(text):
    found = [(m.start(), i, m.end(), kind) for i, (kind, p, good) in enumerate(FORMS) for m in p.finditer(text) if good(m)]
    return sorted(found)


def spans(text):
    out = base(text)
    for i, (kind, pattern, width, least) in enumerate(CLASSES):
        for m in re.finditer(pattern, text):
            word = re.sub(ALLOWED.replace("(?i)", ""), lambda x: " " * len(x[0]), m[0], flags=re.I)
            joined = []
            for a in range(len(word) - width + 1):
                if " " not in word[a : a + width] and entropy(word[a : a + width]) >= least - 1e-9:
                    if joined and joined[-1][1] >= a:
                        joined[-1][1] = a + width
                    else:
                        joined.append([a, a + width])
            out += [(m.start() + a, 3 + i, m.start() + b, kind) for a, b in joined]
    return sorted(out)


def written(found):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
