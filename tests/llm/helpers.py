import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def similar(a, b, num, den):
    common = len(a & b)
    return bool(a) and bool(b) and den * common >= num * (len(a) + len(b) - common)


def group_ids(sets, num, den):
    """Smallest id of each one's component, by all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if similar(sets[i], sets[j], num, den):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed, n=120, vocabulary=60, length=(1, 80)):
    """Texts with families of near copies, exact copies and frequent words."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)] + ["The", "the", "OF"] * 6
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            base = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            out.append(" ".join(base))
        else:
            out.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(*length))))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    return spark.createDataFrame([(None if isinstance(t, tuple) else first + i, t[0] if isinstance(t, tuple) else t, "en", "s", len((t[0] if isinstance(t, tuple) else t) or "")) for i, t in enumerate(texts)], DOCS)
