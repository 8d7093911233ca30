"""Small tables and plain versions that the operators are held against."""

import random
from collections import defaultdict

WHITE = b" \t\n\x0b\x0c\r"


def frame(spark, rows, extra=False):
    """``(doc_id, text)`` rows; with ``extra``, further columns whose names the operators use themselves."""
    schema = "doc_id long, text string"
    if extra:
        rows = [(*r, "x", 1, None, 2.0, "y") for r in rows]
        schema += ", key string, n_words int, found string, score double, kept string"
    return spark.createDataFrame(rows, schema)


def corpus(seed=0, n=60):
    """Texts with copies, near copies, shared passages, repeats, and the odd cases."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(words) for _ in range(70))
    texts = []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(5, 160))]
        kind = i % 6
        if kind == 1 and texts:
            t = texts[r.randrange(len(texts))].split()
            t[r.randrange(len(t))] = "edit"
        elif kind == 2:
            at = r.randrange(len(t))
            t[at:at] = passage.split()
        elif kind == 3 and texts:
            t = texts[r.randrange(len(texts))].split(" ")
        text = " ".join(t)
        if kind == 4:
            text = text.replace(" ", "\n", 3) + "\n  A Line that Many documents share here \n\nend"
        texts.append(text)
    texts += ["", "   \t ", "one", "two words", "same " * 120, "Ünïcode Straße 文字 " * 5, "a\x0bb\x0cc\r\nd"]
    rows = list(enumerate(texts))
    rows += [(len(rows), None), (None, texts[0]), (None, None), (3, texts[3]), (-5, texts[2]), (10**12, texts[2])]
    r.shuffle(rows)
    return rows


def shingles(text, length=5):
    w = (text or "").encode().split()
    return {tuple(w[i:i + length]) for i in range(max(1, len(w) - length + 1))} if w else set()


def near_classes(rows, similarity=0.8):
    """Class of each text that has an id, over distinct texts, linked by brute force."""
    least = {}
    for d, t in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    up = {d: d for d in least.values()}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    sets = {t: shingles(t) for t in least}
    texts = list(least)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((top(least[a]), top(least[b])))
                up[y] = x
    return {t: top(d) for t, d in least.items()}


def without_passages(rows, window=50):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i:i + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode(), len(w), len(gone)))
    return out


def line_key(line):
    key = line.encode().strip(WHITE).decode()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)


def without_lines(rows, min_docs=3, min_chars=20):
    held = defaultdict(list)
    for d, t in rows:
        for key in {line_key(line) for line in (t or "").split("\n")}:
            if d is not None and len(key) >= min_chars:
                held[key].append(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held.get(line_key(x), ())) < min_docs or max(held[line_key(x)]) == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def sort(rows):
    return sorted(rows, key=repr)
