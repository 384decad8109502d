"""Plain versions of operators, row by row."""

import base64
import hashlib
import math
import re
from itertools import pairwise

import regex
from test_operators import plain_counts


def plain_votes(text):
    """Votes of the quality rules, in their order."""
    text = text or ""
    n, chars, symbols, dup_lines, repeated = plain_counts(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    vote = lambda good, bad: -1 if bad else int(good)
    votes = [0] * 7
    if n:
        votes[0] = vote(3 <= chars / n <= 10, chars / n < 2 or chars / n > 20)
        votes[1] = vote(symbols / n <= 0.1, symbols / n >= 0.3)
        votes[3] = vote(repeated / n <= 0.25, repeated / n > 0.5)
        distinct, stops = len(set(words)) / n, len(re.findall("[.!?。！？।؟]", text)) / n
        votes[5] = vote(distinct >= 0.2 and n >= 20, distinct < 0.05 and n < 5000)
        votes[6] = vote(0.01 <= stops <= 0.5, stops == 0 and n >= 100)
    if lines:
        votes[2] = vote(dup_lines / lines <= 0.1 and lines >= 2, dup_lines / lines > 0.3)
    if chars:
        letters = len(regex.findall(r"\p{L}", text)) / chars
        votes[4] = vote(letters >= 0.9, letters < 0.8)
    return votes


def plain_base_failed(text):
    n, _, _, _, repeated = plain_counts(text)
    return n < 50 or 100 * repeated > 50 * n


def plain_quality(texts, starts):
    """Whether each text is kept: expectation-maximisation over single documents, best of the starts."""
    votes = [plain_votes(t) for t in texts]
    open_ = [v for v, t in zip(votes, texts, strict=True) if not plain_base_failed(t)]
    hold = lambda x: min(0.999, max(0.001, x))

    def weigh(v, good, a, b):
        x, y = good, 1 - good
        for j, one in enumerate(v):
            if one:
                x *= a[j] if one == 1 else 1 - a[j]
                y *= b[j] if one == -1 else 1 - b[j]
        return x, y

    best = None
    for good, accuracy in starts:
        a, b, before = [accuracy] * 7, [accuracy] * 7, -math.inf
        for _ in range(200):
            weights = [weigh(v, good, a, b) for v in open_]
            likelihood = sum(math.log(x + y) for x, y in weights)
            if likelihood - before < 1e-9 * abs(likelihood):
                break
            before, share = likelihood, [x / (x + y) for x, y in weights]
            good = hold(sum(share) / len(open_))
            for j in range(7):
                up = [(g, 1 - g) for v, g in zip(open_, share, strict=True) if v[j] == 1]
                down = [(g, 1 - g) for v, g in zip(open_, share, strict=True) if v[j] == -1]
                (gu, bu), (gd, bd) = ([sum(x[i] for x in xs) for i in (0, 1)] for xs in (up, down))
                a[j], b[j] = hold((gu + 1.6) / (gu + gd + 2)), hold((bd + 1.6) / (bu + bd + 2))
                if a[j] + b[j] < 1:
                    a[j] = hold((gu + bu + 1) / (gu + gd + bu + bd + 2))
                    b[j] = 1 - a[j]
        if best is None or likelihood > best[0]:
            best = likelihood, good, a, b
    out = []
    for v, t in zip(votes, texts, strict=True):
        x, y = weigh(v, *best[1:])
        out.append(not plain_base_failed(t) and x >= y)
    return out


SECRETS = [r"(?ia)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"(AKIA[A-Z0-9]+)", r"([0-9a-f]+)"]
LEAST = [8, 16, 32]


def plain_secrets(text):
    """Base spans (start, kind, end)."""
    return sorted((m.start(), k, m.end()) for k, p in enumerate(SECRETS) for m in re.finditer(p, text or "") if len(m[1]) >= LEAST[k])


def plain_redacted(text):
    merged = []
    for start, _, end in plain_secrets(text):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    edges = [[0, 0], *merged, [len(text), len(text)]]
    return "[secret]".join(text[a:b] for (_, a), (b, _) in pairwise(edges))


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
