"""Small tables of odd documents, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows(seed=1, n=120):
    """(doc_id, text, lang, source, kept): copies, near copies, periodic, blank, long and null texts; a clashing extra column."""
    rnd = random.Random(seed)
    words = {"en": "the of and thing over house with night".split(), "de": "und der über haus mit nächte nicht ein".split(), None: "x1 y2 ; ñ ß".split()}
    base = [" ".join(rnd.choice(words[k]) for _ in range(60)) for k in ("en", "de", "en")]
    rows = []
    for i in range(n):
        kind, lang = rnd.random(), rnd.choice(["en", "de", "en", None])
        if kind < 0.2:
            text = rnd.choice(base)
        elif kind < 0.45:
            parts = rnd.choice(base).split(" ")
            for _ in range(rnd.randint(1, 4)):
                parts[rnd.randrange(len(parts))] = rnd.choice(words[lang])
            text = " ".join(parts)
        elif kind < 0.55:
            text = rnd.choice(["To To ", "a\n", "|x| ", "=="]) * rnd.randint(0, 90)
        elif kind < 0.6:
            text = rnd.choice(["", "   \n\t ", "...", "12 34", " 　", "  two  spaces   three \n\n\n end "])
        elif kind < 0.63:
            text = None
        else:
            text = rnd.choice(["", "\n"]).join(" ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(1, 50))) + rnd.choice(["", "!", " $$"]) for _ in range(rnd.randint(1, 3)))
        rows.append((i, text, lang, rnd.choice(["a", "b", "C", None]), "extra"))
    rows.append((n, "".join(rnd.choice("ab cde") for _ in range(30_000)), "en", "a", None))  # long
    rows.append((n + 1, "z" * 4000, "en", "b", "extra"))
    rows.append((3, *rows[3][1:]))  # a repeated row
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, kept string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def sets(rows, n):
    out = {}
    for i, text, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    return out


def components(rows, n, percent=80):
    found = sets(rows, n)
    post, inter, root = defaultdict(list), Counter(), {i: i for i in found}
    for i, s in found.items():
        for x in s:
            post[x].append(i)
    for ids in post.values():
        inter.update((a, b) for k, a in enumerate(sorted(ids)) for b in sorted(ids)[k + 1 :])

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), c in inter.items():
        if 100 * c >= percent * (len(found[a]) + len(found[b]) - c):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(found[i]), top(i)) for i in found}


def without_repeats(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    starts = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if starts[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)
