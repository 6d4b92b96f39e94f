"""Plain versions of the operators, one document at a time."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th string, size string, band int, anchor string, n_words string, gone string, found int, _id long, _rank int, _kept string, _lines int, _gone string, _m_n_words int, row int, lines string, kept int, measured string, rank_id int"


def words(text):
    return WORD.findall(text or "")


def odd_docs(spark):
    """Null ids and texts, empty and long texts, ties, repeated rows, extra columns whose names the operators use inside."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    shared = " ".join(f"s{i}" for i in range(50))
    line = "This line is long enough to count as a boilerplate line."
    texts = [(1, None), (2, ""), (3, "   \n\t"), (None, shared + " tail"), (None, None), (4, long), (5, shared), (5, shared), (5, "other " + shared),
             (6, "one"), (7, "one"), (8, "same " * 200), (9, line + "\n" + line.upper()), *[(10 + i, f"x{i}\n {line} \nend") for i in range(5)],
             (20, "é" * 30 + "   word \0 nul"), (21, "token = 'abcdef12' token=x")]
    rows = [(i, t, None if (i or 0) % 3 == 0 else "en", None if (i or 0) % 4 == 0 else f"src{(i or 0) % 3}", None, 7, "t", "s", 1, "a", "n", "g", 2, 11, 12, "k", 13, "gone", 14, 15, "l", 16, "m", 17) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def without_windows(texts, window=35):
    """[(n_words, n_removed, kept)] by input row."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def line_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def without_lines(rows, shortest=40, copies=5):
    """rows: (id, text), null ids as the one document of the smallest id -> [(n_lines, n_dropped, kept)]."""
    rank = [float("-inf") if i is None else i for i, _ in rows]
    holders = defaultdict(set)
    for r, (_, t) in zip(rank, rows):
        for x in (t or "").split("\n"):
            if len(line_key(x)) >= shortest:
                holders[line_key(x)].add(r)
    out = []
    for r, (_, t) in zip(rank, rows):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(line_key(x), ())) >= copies and r != max(h))]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, k=5):
    w = words(text)
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def near_classes(rows, similar=0.8):
    """rows: (id, text) with distinct ids -> {id: least id of its component}."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and min(sum(a.values()), sum(b.values())) >= similar * max(sum(a.values()), sum(b.values())):
                both = sum((a & b).values())
                if both >= similar * (sum(a.values()) + sum(b.values()) - both):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def benchmark_hits(texts, items, window=10):
    """[(n_words, hit positions, sorted items)]."""
    windows = defaultdict(set)
    for item, text in items:
        w = NORMAL.findall(lower(text))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i:i + size])].add(item)
    sizes, out = {len(x) for x in windows}, []
    for text in texts:
        w, hit, names = NORMAL.findall(lower(text)), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i:i + size])):
                    hit |= set(range(i, i + size))
                    names |= found
        out.append((len(w), hit, sorted(names)))
    return out


def measures(text):
    """The measurements of the ledger, in order."""
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), len(text.split("\n")), len(set(w)),
            len(re.findall("[A-Z]", text)), sum(len(x) <= 2 for x in w))


class Node:
    def __init__(self, tag, attrs, above):
        self.tag, self.attrs, self.above, self.inside = tag, attrs, above, []

    def line(self):
        return [*(self.above.line() if self.above else []), self]

    def walk(self):
        yield self
        for x in self.inside:
            if isinstance(x, Node):
                yield from x.walk()


def page_text(html):
    """Main text by way of a whole tree of elements and questions to it."""
    import math
    from html.parser import HTMLParser
    from paysieve.llm import html_text as M

    root = Node("", [], None)
    events = []  # (kind, text or tag, element) in order of the page

    class Tree(HTMLParser):
        at = root

        def handle_starttag(self, tag, attrs):
            while self.at.tag in M.OPTIONAL_END and tag in M.OPTIONAL_END[self.at.tag]:
                events.append(("cut", "", self.at))
                self.at = self.at.above
            events.append(("start", tag, self.at))
            if tag not in M.VOID:
                node = Node(tag, attrs, self.at)
                self.at.inside.append(node)
                self.at = node

        handle_startendtag = handle_starttag

        def handle_endtag(self, tag):
            events.append(("end", tag, self.at))
            if tag in [x.tag for x in self.at.line()[1:]]:
                while self.at.tag != tag:
                    self.at = self.at.above
                self.at = self.at.above

        def handle_data(self, data):
            events.append(("text", data, self.at))

    tree = Tree(convert_charrefs=True)
    tree.feed(html)
    tree.close()

    def words_of(x):
        return {w for k, v in x.attrs if k in ("class", "id") and v for w in re.findall("[a-z]+", v.lower())}

    def side(x):
        return x.tag not in ("body", "html", "") and (bool(words_of(x) & M.SIDE_WORDS) or any(k == "role" and v and v.lower() in M.ROLES for k, v in x.attrs))

    def outer(x):
        found = [y for y in x.line() if is_region(y)]
        return found[0] if found else None

    def is_region(x):
        return x.tag in ("article", "main") and not side(x) and not any(hides(y) for y in x.line()[:-1])

    def hides(x):
        return (x.tag in M.HIDDEN and x.tag not in M.WRAPPERS or x.tag == "header" and not any(is_region(y) for y in x.line()[:-1])
                or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in x.attrs))

    def box(x):
        return x.tag in M.WRAPPERS or side(x) and x.tag in M.BOXES

    def gone(x):
        return any(box(y) and not any(is_region(z) for z in y.walk() if z is not y) for y in x.line())

    lines, parts, tags, where = [], [], 0, root

    def close(x):
        nonlocal parts, tags
        text = re.sub(r"\s+", " ", "".join(t for t, _ in parts)).strip()
        if text:
            lines.append((text, tags, sum(len(t.strip()) for t, y in parts if y and any(z.tag == "a" for z in y.line())), x))
        parts, tags = [], 0

    for kind, value, x in events:
        tags += kind == "end"
        if kind == "cut" or kind in ("start", "end") and value in M.BLOCKS:
            close(x)
        tags += kind == "start"
        if kind == "start" and value == "br":
            parts.append((" ", None))
        elif kind == "text" and not any(hides(y) for y in x.line()):
            parts.append((value, x))
    close(tree.at)
    lines = [y for y in lines if not gone(y[3])]
    if not lines:
        return ""
    ratio = [len(t) / max(1, n) for t, n, _, _ in lines]
    mean = sum(ratio) / len(ratio)
    least, smooth = math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio)), []
    for i in range(len(lines)):
        near = [(ratio[j], math.exp(-(i - j) ** 2 / 2)) for j in range(len(lines)) if abs(i - j) <= 3]
        smooth.append(sum(r * w for r, w in near) / sum(w for _, w in near))
    good = [x >= min(least, max(smooth)) for x in smooth]
    stays = [i for i, (_, _, _, x) in enumerate(lines) if ratio[i] >= least or not any(side(y) and not box(y) for y in x.line())]
    regions = [outer(x) for _, _, _, x in lines]
    wanted = {regions[i] for i in stays if good[i] and regions[i]} or {regions[i] for i in stays if regions[i]}
    if wanted:
        return "\n".join(lines[i][0] for i in stays if regions[i] in wanted)
    if not any(good[i] for i in stays):
        return "\n".join(lines[i][0] for i in stays)
    keeps = lambda y: y.tag in M.CONTAINERS or y.tag in M.REGIONS
    homes = [[y for y in [root, *x.line()[1:]] if y is root or keeps(y)] for _, _, _, x in lines]
    total = sum(len(lines[i][0]) for i in stays if good[i])
    order = [root, *[y for y in root.walk() if keeps(y)]]
    fits = [y for y in order if sum(len(lines[i][0]) for i in stays if good[i] and y in homes[i]) >= M.NEARLY_ALL * total]
    own = {homes[i][-1] for i in stays if good[i]}
    return "\n".join(lines[i][0] for i in stays if (fits[-1] in homes[i] or homes[i][-1] in own) and (good[i] or 2 * lines[i][2] <= len(lines[i][0])))
