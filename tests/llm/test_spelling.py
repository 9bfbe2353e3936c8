import random
import re
import zlib
from collections import Counter, defaultdict

from maternis.llm import spelling as S
from maternis.llm.common import written


def counted(rows, alter=True):
    """Words of the contract, one run after another."""
    n = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            if alter:
                h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
                if h % 31 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    """Near words by deletions: two words are near only if they share one."""
    by = defaultdict(set)
    for w in words:
        for v in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by[v].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and one_apart(a, b)}
    form = {}
    for w in words:
        best = max(near[w], key=lambda v: (words[v], [-ord(c) for c in v] + [1]), default=None)
        if best is not None:
            best = min((v for v in near[w] if words[v] == words[best]))
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        out.append((w, form[w], r, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_dictionary_numbers_trie_nodes_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_CHARS", 60)
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"a" * 300, "a" * 299 + "b"})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    rows = S.dictionary(df).collect()
    for column, part in (("prefixes", lambda w, i: w[:i]), ("suffixes", lambda w, i: w[len(w) - i:])):
        node = {}
        for r in rows:
            assert len(r[column]) == len(r.word) + 1
            for i, x in enumerate(r[column]):
                assert node.setdefault(part(r.word, i), x) == x  # one node for one part
        assert len(set(node.values())) == len(node)  # and one part for one node
    assert [r.word for r in sorted(rows, key=lambda r: r.id)] == words  # ids in code-point order


def test_random_words_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_CHARS", 900)
    rng = random.Random(5)
    words = {}
    for _ in range(60):
        w = "".join(rng.choice("abcç") for _ in range(rng.randint(7, 10)))
        words[w] = rng.randint(2, 3000)
        for _ in range(12):
            v, i = words and rng.choice(list(words)), rng.randint(0, 6)
            v = rng.choice([v[:i] + v[i + 1:], v[:i] + rng.choice("abcç") + v[i:], v[:i] + rng.choice("abcç") + v[i + 1:]])
            if len(v) >= 7:
                words.setdefault(v, rng.choice([2, 3, 20, 30, 300]))
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = brute(words)
    assert got(S.variants(df)) == want
    assert sum(r[4] for r in want) > 200 and any(r[2] != (r[1] or r[0]) for r in want)
    pairs = [(r.a, r.b) for r in S.near_words(written(S.dictionary(df), "d")).collect()]
    assert len(pairs) == len({tuple(sorted(p)) for p in pairs}) == sum(r[4] for r in want) // 2


def test_edges(spark):
    long = "x" * 5000
    rows = [(1, None, 0), (2, "", 0), (None, "Wordword wordword", 0), (3, "WORDWORD wordwor short été", 1), (3, "wordwor", 1),
            (4, long + " " + long + "y " + long + "y " + long, 2), (5, "ÀÀÀÀÀÀÀÀ ààààààà ààààààà ÀÀÀÀÀÀÀÀ", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word int")
    for alter in (False, True):
        words = counted([r[:2] for r in rows], alter)
        assert got(S.spelling_variants(df, word_of=S.altered if alter else S.plain)) == brute(words)
    assert "wordword" in counted([r[:2] for r in rows], False)
    assert S.spelling_variants(df.limit(0)).collect() == []


def test_ties_go_to_the_smallest_word(spark):
    words = {"abcdefg": 2, "abcdefgz": 50, "abcdefga": 50, "bbcdefg": 50, "abcdefgaa": 500}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    rows = {r[0]: r for r in got(S.variants(df))}
    assert rows["abcdefg"][1:] == ("abcdefga", "abcdefgaa", 2, 3, 50)
    assert list(rows.values()) == brute(words)


def test_query_against_brute_force(spark):
    from maternis.llm.queries import op12_spelling
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op12_spelling(spark, sf)) == brute(counted(rows))
