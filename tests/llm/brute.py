"""Plain versions of the operators, for small tables."""

import functools
import hashlib
import html
import math
import re
import zlib
from collections import Counter

SPACE = r"[\x20\x09-\x0D]"


def shingles(text, width=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(rows, percent=80):
    """{id: (set size, smallest id reached)}."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    held = {}
    for i, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in held[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def dedup(rows):
    """{id: (id that stays, group size)}."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(SPACE, "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def page_text(page):
    """Main text of a page of nav, footer, .ad, article, div, p, h1, b, a, br and li only, by tag-path ratios over whole path strings."""
    blocks, stack, text, number, link = [], [], [], 0, False

    def close():
        nonlocal text
        whole = "".join(t for t, _ in text)
        if whole.split() and not any(t in ("head", "nav", "footer", 'div class="ad"') for t, _ in stack):
            size = [(len("".join(html.unescape(t).split())), linked) for t, linked in text]
            blocks.append((" ".join(html.unescape(whole).split()), tuple(stack), sum(n for n, linked in size if linked) / sum(n for n, _ in size)))
        text = []

    for piece in re.split(r"(<script.*?</script>|<style.*?</style>|<title.*?</title>|<!--.*?-->|<[^>]*>)", page or "", flags=re.S):
        m = re.match(r"<(/?)(\w+)(.*)>", piece, re.S)
        tag = m[2] if m else None
        if not piece.startswith("<"):
            text.append((piece, link))
        elif tag == "br":
            text.append((" ", link))
        elif tag == "a":
            link = not m[1]
        elif m and tag not in ("b", "meta", "script", "style", "title"):
            if m[1]:
                if tag in [t.split()[0] for t, _ in stack]:
                    close()
                    while stack.pop()[0].split()[0] != tag:
                        pass
                continue
            close()
            for old in ("p", "li"):
                if [t for t, _ in stack][-1:] == [old] and (old == "p" or tag == "li"):
                    stack.pop()
            number += 1
            stack.append((tag + m[3], number))
    close()
    paths = ["/".join(t for t, _ in s) for _, s, _ in blocks]
    mean = lambda f: [sum(f(b) for (b, _, _), q in zip(blocks, paths) if q == p) / paths.count(p) for p in paths]
    smooth = lambda x: [(v + 0.25 * (x[max(i - 1, 0)] + x[min(i + 1, len(x) - 1)])) / 1.5 for i, v in enumerate(x)]
    fused = [a * (1 + b) ** 0.5 for a, b in zip(smooth(mean(len)), smooth(mean(lambda t: len(re.findall(r"[.,;:!?…、。，；：！？¿¡،؛؟]", t)))))]
    size = sum(len(t) for t, _, _ in blocks)
    named = 2 * sum(len(t) for (t, _, _), p in zip(blocks, paths) if "article" in p) >= size

    def ratio(p):
        own = [(f, len(t), linked) for f, q, (t, _, linked) in zip(fused, paths, blocks) if q == p]
        free = 1 - sum(n * linked for _, n, linked in own) / sum(n for _, n, _ in own)
        return sum(f for f, _, _ in own) / len(own) * free * (0.1 if named and "article" not in p else 1)

    ratio = {p: ratio(p) for p in set(paths)}
    cut = 0.6 * sum(ratio[p] * len(t) for p, (t, _, _) in zip(paths, blocks)) / max(1, size)
    kept = [s for p, (_, s, _) in zip(paths, blocks) if ratio[p] >= cut]
    n = 0
    while kept and all(len(s) > n for s in kept) and len({s[n] for s in kept}) == 1:
        n += 1
    top = kept[0][: n - (len(kept) == 1)] if kept else ()
    inner = top and top[-1][0].split()[0] not in ("html", "body")
    stay = [ratio[p] >= cut or inner and s[: len(top)] == top for p, (_, s, _) in zip(paths, blocks)]
    for i in reversed(range(len(blocks) - 1)):
        stay[i] = stay[i] or not inner and stay[i + 1] and blocks[i][1][-1][0] == "h1"
    return "\n".join(t for (t, _, _), k in zip(blocks, stay) if k)


def line_dedup(rows, least_points=40, least_docs=5):
    """[(id, lines, lines that go, sha256 of what stays)] in the order of rows."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    held = {}
    for i, lines in split:
        for k in map(key, lines):
            if len(k) >= least_points:
                held.setdefault(k, set()).add(i)
    last = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for i, lines in split:
        stay = [x for x in lines if last.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def search(docs, items, k=10):
    """{(item, rank, doc, score)}."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = set()
    for item, want in asked.items():
        found = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in want.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])}
    return out


def damage(rows):
    out = []
    for row in rows:
        conv, turn, role, text = (" " if x is None else x for x in row)
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(row[0], row[1], "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repair(rows):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)} by trying every edit."""
    out = {}
    turns = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in turns if r[0] == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        faults, seen = [], set()
        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

        @functools.cache
        def best(k, state, inserted):
            ways = [(0, "", "")] if k == len(own) and state in ("", "a") else []

            def add(price, letter, to, inserted, text):
                c, audit, rest = best(to[0], to[1], inserted)
                ways.append((c + price, letter + audit, text + rest))

            for letter, name in (("u", "user"), ("a", "assistant")):
                to = follow[state].get(letter)
                if to and inserted < 3:
                    add(5, "I", (k, to), inserted + 1, f"\n{name}:")
                if to and k < len(own) and faults[k] not in ("blank", "duplicate"):
                    add(1 + 5 * (faults[k] == "truncated"), "R", (k + 1, to), 0, f"\n{name}:{own[k][2]}")
            if k < len(own):
                add(2, "D", (k + 1, state), 0, "")
                to = follow[state].get(own[k][1][:1])
                if to and faults[k] not in ("blank", "duplicate"):
                    add(5 * (faults[k] == "truncated"), "K", (k + 1, to), 0, f"\n{own[k][1]}:{own[k][2]}")
            return min(ways) if ways else (10**9, "", "")

        cost, audit, text = best(0, "", 0)
        numbers = {t for t, _, _ in own if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text[1:].encode()).hexdigest(),
        )
    return out
