"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(_LOWER))


def shingle_set(text, size):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def near_components(rows, size, percent):
    """[(doc_id, n, component_id)] for rows (doc_id, text)."""
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    done = set()
    for members in where.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(known) if known else None
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def kneser_ney(rows):
    """{position: (n_tokens, n_known, N, base, score)} by the textbook formulas."""
    seqs = [words(t) + ["</s>"] for _, t in rows]
    train = [s for (d, _), s in zip(rows, seqs) if not held_out(d)]
    uni = Counter(w for s in train for w in s)
    big = Counter(p for s in train for p in zip(["<s>", *s], s))
    follow = Counter(w for _, w in big)
    total, kinds = Counter(), defaultdict(Counter)
    for (v, _), c in big.items():
        total[v] += c
        kinds[v][min(c, 3)] += 1

    def discounts(values):
        n1, n2, n3, n4 = (sum(v == k for v in values) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y]
        return [0.0] + [min(max(d, 0.0), k) for k, d in enumerate(raw, 1)]

    d2, d1 = discounts(big.values()), discounts(follow.values())
    pairs, types, tokens = len(big), len(uni), sum(uni.values())
    free = sum(d1[min(c, 3)] for c in follow.values()) / pairs if pairs else 1.0

    def p_low(w):
        return max(follow[w] - d1[min(follow[w], 3)], 0) / max(pairs, 1) + free / (types + 1)

    def p(v, w):
        if not total[v]:
            return p_low(w)
        back = sum(d2[k] * n for k, n in kinds[v].items()) / total[v]
        c = big[v, w]
        return max(c - d2[min(c, 3)], 0) / total[v] + back * p_low(w)

    out = []
    for (d, _), s in zip(rows, seqs):
        base = sum(math.log10((uni[w] + 0.1) / (tokens + 0.1 * (types + 1))) for w in s)
        out.append((d, held_out(d), len(s), sum(uni[w] > 0 for w in s), tokens, base, sum(math.log10(p(v, w)) for v, w in zip(["<s>", *s], s))))
    return out


def removed_spans(rows, size=50):
    """[(doc_id, n_bytes, n_removed, n_spans, kept)] for rows (doc_id, text)."""
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            least[s] = min(least.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if least[b[i : i + size]] < d:
                gone[i : i + size] = b"\x01" * size
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind, match):
    numbers = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "phone":
        return 9 <= len(numbers) <= 15
    if kind == "card":
        total = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(numbers)))
        return 13 <= len(numbers) <= 19 and total % 10 == 0
    return True


def base_spans(text):
    """[(kind, start, end)] of the base rules."""
    return [
        (kind, m.start(), m.end())
        for kind, pattern in _PII.items()
        for m in re.finditer(pattern, text or "")
        if _passes(kind, m[0])
    ]


def alignment(rows, byte_model, piece_model):
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) token by token."""
    import hashlib
    from collections import Counter

    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(byte_model)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    alphabet = {}
    rest = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            alphabet[chr(b)] = b
        else:
            alphabet[chr(256 + rest)] = b
            rest += 1

    def piece(i):
        token = second.id_to_piece(i)
        return bytes([int(token[3:5], 16)]) if second.is_byte(i) else token.replace("▁", " ").encode()

    out, held, docs = [], Counter(), []
    for d, text in rows:
        whole = (" " + text).encode() if text else b""
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [piece(i) for i in b]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a = b = a_bytes = b_bytes = []
        groups = []
        spans_a, spans_b = [], []
        for spans, tokens in ((spans_a, a_bytes), (spans_b, b_bytes)):
            place = 0
            for t in tokens:
                spans.append((place, place + len(t)))
                place += len(t)
        links = [(a[x], b[y]) for x, (s, e) in enumerate(spans_a) for y, (u, v) in enumerate(spans_b) if s < v and u < e]
        ends = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        begin = 0
        for end in ends:
            ga = ",".join(str(a[x]) for x, (s, e) in enumerate(spans_a) if begin < e <= end)
            gb = ",".join(str(b[x]) for x, (s, e) in enumerate(spans_b) if begin < e <= end)
            groups.append(f"{ga}|{gb}")
            begin = end
        held.update(set(links))
        docs.append((d, a, b, groups, links))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(n, top.get(a, 0))
    for d, a, b, groups, links in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((d, len(a), len(b), len(groups), len(links), digest, sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links)))
    return out


def manifest(rows, tampered):
    """(doc_id, leaf, subroot, root, siblings' digest, folded root, verified) for rows
    (doc_id, source, lang, n_chars, text); ``tampered(row)`` gives the row that is presented."""
    import hashlib

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def walk(tree, at, digest, siblings):
        for nodes in tree[:-1]:
            run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
            siblings += [n for k, n in enumerate(run) if k != at % 2]
            run[at % 2] = digest
            digest, at = h(*run), at // 2
        return digest

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[g]]) for g in names]
    upper = levels([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for at, row in enumerate(groups[g]):
            siblings = []
            top = walk(upper, k, walk(trees[k], at, leaf(tampered(row)), siblings), siblings)
            out.append((row[0], leaf(row), trees[k][-1][0], upper[-1][0], h(*siblings), top, top == upper[-1][0]))
    return out
