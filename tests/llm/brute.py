"""Plain-Python answers to compare the operators with, and tables of odd cases."""
import hashlib
import re

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
#: Nulls, empty and blank texts, repeated rows and ids, wide characters, a long text, no separators.
ODD = [
    (9000, None), (9001, ""), (9002, " \n"), (None, "no id here at all"), (None, None), (9003, "one"), (9003, "one"), (9003, "another text of the same id"),
    (9004, "é à  b   c   d　e"), (9005, "日本語 テキスト。東京 "), (9006, "don't won't 'tis it's: 'll  "), (9007, "x<|endoftext|>y <|endoftext|> z"),
    (9008, "<|ENDOFTEXT|> <|startoftext|>"), (9009, "word."*3000), (9010, "ab " * 40000), (9011, "a" * 9000), (9012, "Ünï ΣΑΣ İstanbul\r\n\r\nx\x0b\x0cy z"), (9013, "12345 67 a1b2,c3"),
]


def table(spark, rows=ODD, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def clashing(docs):
    """The same rows with more columns, named as results and inner columns are."""
    from pyspark.sql import functions as F

    names = "doc row n_bytes n_tokens score lang_pred start length key cell window set_id kept_text removed hit items segment rank query_id host path rule verdict".split()
    return docs.select("*", *[F.lit("clash").alias(n) for n in names])


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def kept_bytes(rows, width):
    seen, multi = set(), set()
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            (multi if w in seen else seen).add(w)
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if b[s : s + width] in multi:
                gone[s : s + width] = b"\1" * width
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def jaccard_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(len(w) - words, 0) + 1)) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if a and b and min(a, b) * 100 >= percent * max(a, b):
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (a + b - n):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def contaminated(docs, items, width=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, t in items:
        w = pattern.findall(lower(t))
        for s in range(max(len(w) - width, 0) + 1):
            if w and item is not None:
                windows.setdefault(tuple(w[s : s + width]), set()).add(item)
    lengths, out = {len(k) for k in windows}, []
    for d, t in docs:
        w, hit, found = pattern.findall(lower(t)), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


def removed_lines(rows, run, words=None):
    """rows: (doc_id, text, hash of both). With ``words`` shorter runs that hold that many words count too."""
    seen, out = set(), []
    for d, t, h in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        lines = t.removesuffix("\n").split("\n") if t else []
        plain, gone = [lower(x.strip(" \t\n\v\f\r")) for x in lines], set()
        for n in range(run if words is None else 1, run + 1):
            for i in range(len(plain) - n + 1):
                w = tuple(plain[i : i + n])
                if any(w) and (n == run or sum(len(re.findall(r"[^ \t\n\v\f\r]+", x)) for x in w) >= words):
                    if w in seen:
                        gone.update(range(i, i + n))
                    seen.add(w)
        kept = [x for i, x in enumerate(lines) if i not in gone]
        out.append((h, "\n".join(kept) + ("\n" if kept and t.endswith("\n") else ""), len(lines), sorted(gone)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)
