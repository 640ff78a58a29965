"""The ten operators on small inputs: brute force, exact round trips, and the odd cases (nulls, empty, ties, repeats, clashing names)."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import bpe, html_extract, jaccard_join, mixing, order, quality, queries, sharding, simhash, substring_dedup, token_count, toxicity
from lectern.llm.scratch import Scratch
from lectern.llm.tokens import STRETCH, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCAB = [f"w{i}" for i in range(400)]
ODD = [None, "", " \n\t ", "one", "two words", "Three Words Here", "x " * 30, "é" * 300, "🙂 z​ q  \x85d", "a\x1c b  c"]


def documents(n=60, seed=1):
    random.seed(seed)
    rows = [(i, t, "en", "s0", 0) for i, t in enumerate(ODD)]
    for i in range(len(ODD), n):
        rows.append((i, " ".join(random.choice(VOCAB) for _ in range(random.choice([3, 20, 60, 200]))), "en", random.choice(["s0", "s0", "s1", "b", None]), 0))
    rows.append((n, rows[20][1], "en", "s1", 0))
    rows.append((n + 1, rows[20][1].upper(), "en", None, 0))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_jaccard_join_against_all_pairs(spark, width, num, den):
    random.seed(3)
    rows = [(i, t) for i, t in enumerate(ODD)]
    for length in (1, 2, 3, 5, 8, 20, 40, 80, 200):
        base = [random.choice(VOCAB) for _ in range(length)]
        for _ in range(12):
            t = base[:]
            for _ in range(random.randint(0, max(1, length // 12))):
                at = random.randrange(len(t) or 1)
                t[at : at + 1] = random.choice([[], [random.choice(VOCAB)], [random.choice(VOCAB), *t[at : at + 1]]])
            rows.append((len(rows), " ".join(t)))
            base = t if random.random() < 0.3 and t else base
    rows.append((len(rows), rows[30][1]))
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, width=width, num=num, den=den).collect()}
    want = components(rows, width, num, den)
    assert got == want
    if width == 5:
        kept = {r.doc_id for r in jaccard_join.keep_one(df, width=width, num=num, den=den).collect()}
        assert kept == {c for _, c in want.values()}


def test_words_of_long_texts_stay_in_order(spark):
    random.seed(4)
    texts = [" ".join(random.choice(VOCAB) for _ in range(random.choice([0, 2, 9, 80]))) for _ in range(60)]
    for size in (16, 64, 256):
        h, bounds = word_hashes(texts, size)
        for i, t in enumerate(texts):
            assert (h[bounds[i] : bounds[i + 1]] == word_hashes([t])[0]).all()
    long = " ".join(f"v{i}" for i in range(300_000))
    assert len(long) > 2 * STRETCH
    short = " ".join(random.choice(VOCAB) for _ in range(40))
    mixed = [short, "other words " + short, long, short, long + " more"]
    runs = jaccard_join.Sets(mixed, 5).runs
    assert all((x == jaccard_join.Sets([t], 5).runs[0]).all() for x, t in zip(runs, mixed, strict=True))
    df = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()}
    assert got == components(list(enumerate(mixed)), 5, 8, 10)


def test_jaccard_join_of_families_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BATCH", 3)
    rows, want = [], {}
    for seed in range(600):
        rng = random.Random(seed)
        words = [f"f{seed}w{i}" for i in range(27)]
        family = [set(rng.sample(words, 9))]
        while len(family) < 8:
            x = set(rng.choice(family[-4:]))
            for _ in range(rng.choice([1, 1, 2, 3])):
                if rng.random() < 0.5 and len(x) > 3:
                    x.remove(rng.choice(sorted(x)))
                else:
                    x.add(rng.choice(words))
            family.append(x)
        rng.shuffle(family)
        part = [(len(rows) + i, " ".join(sorted(x))) for i, x in enumerate(family)]
        rows += part
        want |= components(part, 1, 8, 10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()}
    assert got == want


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.join(empty).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n")]
    df = empty.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect())
    assert got == [("1", 3, 1), ("1", 3, 1), ("2", 3, 1), ("3", 3, 3), ("None", 3, None)]
    assert sorted(str(r.doc_id) for r in jaccard_join.keep_one(df).collect()) == ["1", "3", "None"]


def test_chunks_survive_shifts_and_long_texts():
    random.seed(5)
    text = " ".join(random.choice(VOCAB) for _ in range(3000))
    a, b = substring_dedup.Chunks([text]), substring_dedup.Chunks(["some words before it " + text])
    assert len(set(a.digest.tolist()) & set(b.digest.tolist())) >= len(set(a.digest.tolist())) - 3
    assert int(a.words.sum()) == 3000
    step, substring_dedup.STRETCH = substring_dedup.STRETCH, 1000
    try:
        c = substring_dedup.Chunks([text])
    finally:
        substring_dedup.STRETCH = step
    assert (c.digest == a.digest).all() and (c.start == a.start).all()


def test_substring_dedup_catches_passages(spark):
    random.seed(6)
    make = lambda n: " ".join("".join(random.choice("abcdefgh") for _ in range(random.randint(1, 9))) for _ in range(n))
    texts = [make(random.randint(60, 200)) for _ in range(120)]
    where = {}
    for _ in range(12):
        passage = make(51)
        for i in random.sample(range(120), 2):
            words = texts[i].split(" ")
            at = random.randrange(len(words))
            texts[i] = " ".join([*words[:at], passage, *words[at:]])
            where.setdefault(passage, []).append(i)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(200, None, "x"), (201, "", "x"), (202, texts[0], "x"), (202, texts[0], "x")]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, removed_words string").repartition(3)).collect()}
    found = {i for i, r in got.items() if r.repeat_words}
    assert {i for v in where.values() for i in v} | {0, 202} == found
    assert got[202].text == "" and got[202].first_ids == [0] and got[200].text is None
    assert all(r.removed_words == 0 and r.text == texts[i] for i, r in got.items() if i < 120 and i not in found)


def test_html_extract(spark):
    random.seed(7)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(150):
        a, b = ([random.choice("abcd") for _ in range(random.choice([0, 5, 30, 600][: 3 + (k == 1)]))] for k in range(2))
        same = html_extract.shared(a, b)
        rest = iter(b)
        assert len(same) == length(a, b) and all(a[i] in rest for i in same)
    page = "<title>T</title><nav>menu</nav><div class='site-Header'>h</div><article><h1>A &amp; B</h1><p>one\n two<p><b>three<br>four<div id=comments><p>c</p></div></article><footer>f</footer><script>x='</p>'</script>"
    rows = [
        (1, "http://h/a/1", "<div>menu a b</div><div>first text</div><div>foot</div>"), (2, "http://h/a/2", "<div>menu a b</div><div>second text</div><div>foot</div>"),
        (3, None, None), (4, "http://g/x", "<div>menu a b</div>"), (5, "http://h/z", page), (6, "::bad[", ""),
    ]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("first text", 10), 2: ("second text", 11), 3: ("", 0), 4: ("menu a b", 8), 5: ("A & B\none two\nthree\nfour", 24), 6: ("", 0)}


def test_simhash_and_edited_texts(spark, docs, empty):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in simhash.compare_edited(docs).collect()}
    for k, (i, t) in enumerate(rows):
        third = len(t) // 3
        edited = t[: len(t) - third] + rows[(k + 1) % len(rows)][1][:third]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[20].fingerprint == got[60].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert simhash.compare_edited(empty).count() == 0
    far = [(i, f"text number {i} of many") for i in (1, 2, 3, 10**12, 10**12 + 5)] + [(10**6 + i, f"t {i}") for i in range(700)]
    odd = far + [(2, "text number 2 of many"), (None, "no key"), (None, None)]  # ids far apart, a repeated row, rows without a key
    order = sorted(odd, key=lambda r: (0 if r[0] is None else r[0], r[1] or ""), reverse=True)
    got = sorted((str(r.doc_id), r.edited_sha256) for r in simhash.compare_edited(spark.createDataFrame(odd, "doc_id long, text string")).collect())
    want = []
    for k, (i, t) in enumerate(order):
        t, follows = t or "", order[(k + 1) % len(order)][1] or ""
        want.append((str(i), hashlib.sha256((t[: len(t) - len(t) // 3] + follows[: len(t) // 3]).encode()).hexdigest()))
    assert got == sorted(want)


def test_fingerprint_bits_against_brute_force(spark):
    """Votes counted one by one; only the hash of a term is taken from the engine."""
    random.seed(12)
    texts = [" ".join(random.choice(VOCAB) + random.choice(["", "longer"]) for _ in range(n)) for n in (1, 2, 3, 17, 200)] + ["", None, "x " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in simhash.fingerprints(df, ["doc_id"], "text").collect()}
    pairs = sorted({(a, b) for t in texts for w in [WORD.findall(t or "")] for a, b in zip(w, [*w[1:], None])}, key=str)
    hashed = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h")).withColumn("h1", F.xxhash64("h", F.lit(1))).collect()
    known = {(r.a, r.b): (r.h % 2**64, r.h1 % 2**64) for r in hashed}
    for i, t in enumerate(texts):
        votes, total = [0] * 128, 0
        for a, b in zip(w := WORD.findall(t or ""), [*w[1:], None]):
            weight = 2 if len(a) + len(b or "") >= 8 else 1
            total += weight
            for half, h in enumerate(known[a, b]):
                for bit in range(64):
                    votes[64 * half + bit] += weight * (h >> bit & 1)
        words = [sum(1 << bit for bit in range(64) if 2 * votes[64 * half + bit] > total) for half in range(2)]
        assert got[i] == f"{words[0]:016x}{words[1]:016x}"


def test_near_fingerprints_against_all_pairs(spark):
    random.seed(8)
    prints = [f"{random.getrandbits(128):032x}" for _ in range(40)]
    for p in prints[:20]:
        x = int(p, 16)
        for b in random.sample(range(128), random.choice([1, 2, 3, 4, 5])):
            x ^= 1 << b
        prints.append(f"{x:032x}")
    prints += [prints[0]] * 3  # copies
    df = spark.createDataFrame([*enumerate(prints), (None, None)], "doc_id long, fingerprint string")
    gap = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    got = {(r.a, r.b): (r.distance, r.members) for r in simhash.near(df, radius=3).collect()}
    assert got == {(a, b): (gap(a, b), prints.count(b)) for a in prints for b in prints if a != b and gap(a, b) <= 3}
    wide = {(r.a, r.b) for r in simhash.near(df, radius=5, agree=1).collect()}
    assert wide == {(a, b) for a in prints for b in prints if a != b and gap(a, b) <= 5}
    rows = {r.doc_id: r.n_near for r in simhash.with_near(df, F.col("doc_id") % 10 == 0).collect()}
    assert len(rows) == len(prints) + 1
    assert all(rows[i] == (sum(p != q and gap(p, q) <= 3 for q in prints) if i % 10 == 0 else None) for i, p in enumerate(prints))


def test_sharding(spark):
    random.seed(9)
    texts = [None, "", ""] + ["copy"] * 40 + ["other"] * 5 + [f"t{i}" for i in range(150)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, shard int").repartition(4)
    rows = sharding.shard(df, shards=8).collect()
    counts = {}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(t) + 8 and r.text_crc32 == zlib.crc32(t) and r.law == "rows"
        counts.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(texts) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert len({r.shard for r in rows if texts[r.doc_id] == "other"}) <= 2
    assert len({r.shard for r in rows if texts[r.doc_id] == "copy"}) <= 3
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df, shards=8).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_sharding_of_repeated_rows_and_null_keys(spark, empty):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (None, None), (2, None), (2, None)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=3).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in out) == sorted((str(i), len(t or "") + 8) for i, t in rows)
    counts = [sum(r.shard == s for r in out) for s in range(3)]
    assert max(counts) - min(counts) <= 1
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(3) for k in range(counts[s])]
    assert sharding.shard(empty, shards=3).count() == 0


def test_filter_on_verdicts_costs_no_more_than_the_verdicts(spark):
    import time

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def seconds(df):
        best = 1e9
        for _ in range(2):
            began = time.time()
            df.write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        return best

    judged = quality.judge(docs)
    assert seconds(judged.filter("kept")) < 2.5 * seconds(judged) + 0.5


def test_quality_counts_against_brute_force(docs, empty):
    def counts(t):
        t = t or ""
        w = WORD.findall(t)
        seen, covered = {}, set()
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                covered.update(k for i in at for k in range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    more = docs.union(docs.sparkSession.createDataFrame([(900 + k, t, "en", "s", 0) for k, t in enumerate(["a b c d e f g h\n" * 4 + "x", "a | b | c | d" * 9, "# % & *" * 5])], SCHEMA))
    texts = {r.doc_id: r.text for r in more.collect()}
    for r in quality.judge(more).collect():
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0


def test_quality_lines(spark):
    good = "This is a sentence of the body that says something with many different plain words in it and ends well."
    rows = [(1, f"{good}\nAnother line follows here, with quite other words, so that nothing of it comes twice."), (2, f"{good}\nHome | About | Contact | News | Shop | Help | Login | Search | Terms | Map | Top | Next | Prev | End"), (3, f"{good}\n\nWe use cookies. Read more."),
            (4, "BUY!! NOW!! CHEAP!! " * 12), (5, "The The The The The other other other other same same same same " * 3)]
    got = {r.doc_id: (r.kept, r.clean_text) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (True, rows[0][1]) and got[3][1] == good + "\n"
    assert got[2][1] == good and not got[2][0]
    assert not got[4][0] and not got[5][0]


def test_bpe_is_what_the_library_gives(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(10)
    odd = [t or "" for t in ODD] + ["<|endoftext|> it's  we'll\n\n x", "a" * 5000, "é" * 500] + ["".join(random.choice("ab '\n\té1!.🙂 \x85 sl") for _ in range(random.randint(1, 60))) for _ in range(2000)]
    coder = bpe.Coder(open(RANKS, "rb").read(), "ranks", public_tokenizers.PATTERN)
    for t, ids in zip(odd, coder.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == texts
    for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_are_the_library_s(spark, docs, empty, name):
    if name.endswith(".model"):
        pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        count = lambda t: len(pieces.encode(t))
    else:
        library = Tokenizer.from_file(public_tokenizers.path(name))
        count = lambda t: len(library.encode(t, add_special_tokens=False))
    assert token_count.token_counts(empty, public_tokenizers.path(name)).count() == 0
    assert [len(b) for b in token_count.by_bytes(["é" * 3, "é" * 3, "a"], 12)] == [2, 1]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(901, "a <|endoftext|> b<|endoftext|>"), (902, "word " * 3000)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in more.collect()}
    for r in token_count.token_counts(more, public_tokenizers.path(name)).collect():
        n = count(texts[r.doc_id])
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


def fill(sizes, weights, most):
    """Targets by resharing what is above a cap, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, free = total - sum(fixed.values()), [s for s in names if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing(spark, docs, empty):
    plan = mixing.mix(docs).collect()
    sizes, taken = {}, {}
    for r in plan:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = fill(sizes, (5, 2, 1), 3)
    for r in plan:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    key = lambda r: r.doc_id
    assert sorted(mixing.mix(docs.repartition(7)).collect(), key=key) == sorted(plan, key=key)
    words = sum(len(WORD.findall(r.text or "")) for r in mixing.sample(docs).collect())
    assert words == sum(taken.values())
    odd = docs.withColumn("doc_id", F.expr("case when doc_id % 3 > 0 then doc_id % 5 end"))  # repeated and null keys
    plan = mixing.mix(odd).collect()
    assert len(plan) == docs.count() and all(0 <= r.taken <= 3 * r["size"] for r in plan)
    assert sum(len(WORD.findall(r.text or "")) for r in mixing.sample(odd).collect()) == sum(r.taken for r in plan) == sum(taken.values())
    assert mixing.sample(empty).count() == 0
    assert mixing.mix(empty).count() == 0


def test_order_is_gapless(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 7 else None, i % 5) for i in range(300)], "id long, g long, v long")
    places = {}
    for r in order.row_index(df, ["g"], "id", "n").collect():
        places.setdefault(r.g, []).append(r.n)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_crf_marginals_and_training():
    rng = np.random.default_rng(0)
    crf = toxicity.Crf()
    e, lengths = rng.normal(0, 2, 300), np.array([1, 70, 129, 64, 36])
    p, t, k = crf.marginals(e, lengths), np.exp(crf.move), 0
    for n in lengths:
        x = np.exp(e[k : k + n])
        a = [np.array([np.exp(crf.first[0]), np.exp(crf.first[1]) * x[0]])]
        for i in range(1, n):
            a.append((a[-1] @ t) * [1, x[i]])
        b = np.ones(2)
        for i in range(n - 1, -1, -1):
            assert p[k + i] == pytest.approx((a[i] * b)[1] / (a[i] * b).sum())
            b = t @ (b * [1, x[i]])
        k += n
    random.seed(11)
    bad = ["awful", "rotten", "nasty"]
    make = lambda toxic: " ".join(random.choice(bad) if toxic and random.random() < 0.1 else random.choice(VOCAB) for _ in range(80))
    y = np.arange(240) % 2
    model = toxicity.train([make(v) for v in y], y)
    texts = [make(v) for v in y] + [None, ""]
    sums, spans = model.tag(texts, spans=True)
    score = model.score(sums)
    assert ((score[:240] >= 0.5) == y).mean() > 0.95 and (score[240:] < 0.5).all()
    assert all(w in bad for i in range(240) for a, b in spans[i] for w in texts[i][a:b].split(" "))
    assert any(len(texts[i][a:b].split(" ")) > 1 for i in range(240) for a, b in spans[i])
    short = toxicity.train([" ".join(t.split(" ")[:9]) for t in texts[:240]], y)  # texts shorter than a window teach too
    assert np.abs(short.weights).sum() > 0
    again = model.tag(texts[::-1])[0][::-1]
    for k in range(0, 242, 7):  # the score of a text: forward-backward over it alone, whatever is in its batch
        sums_alone = model.tag([texts[k]])[0]
        assert sums_alone[0] == pytest.approx(sums[k]) and again[k] == pytest.approx(sums[k])


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r.score < 0.5 for r in scored)


def test_queries_register_ten_operators():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.queries()} == set(range(1, 11))


def test_oracle_sql_of_the_queries(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, "/root/testdata/sf0.001")
        columns = sorted(df.columns)
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in columns]
        clean = lambda v: round(v, 6) if isinstance(v, float) else v
        want = sorted(tuple(map(clean, (r[i] for i in at))) for r in rel.fetchall())
        assert sorted(tuple(clean(r[c]) for c in columns) for r in df.collect()) == want, name


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and 4 <= len(corpus_pipeline.STAGES) <= 5
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs, scratch = rows, Scratch(spark, "test")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = scratch.table(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == rows.columns
        if k == 1:
            unlinked = components([(r.doc_id, r.text) for r in docs.collect()], 5, 8, 10)
            assert all(i == c for i, (_, c) in unlinked.items())
    out = corpus_pipeline.STAGES[4][1](spark, docs, "")
    assert out.count() == docs.count() and out.agg(F.min("n_tokens")).first()[0] > 0


def test_pipeline_on_odd_rows_and_on_nothing(spark, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    random.seed(13)
    say = lambda n: "".join("".join(random.choice("abcdefgh") for _ in range(6)) + " " for _ in range(n)).strip() + "."
    good, other = say(60), say(70)
    rows = [(1, good, "en", "a", 0), (1, good, "en", "a", 0), (2, good + " end.", "en", "a", 0), (3, other, None, None, None), (None, say(50), "en", "a", 0), (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, "too short.", "en", "b", 0)]
    for docs, ids in ((spark.createDataFrame(rows, SCHEMA).repartition(3), ["1", "3", "None"]), (empty, [])):
        scratch = Scratch(spark, "odd")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = scratch.table(stage(spark, docs, ""))
            if k < 4:
                assert docs.columns == empty.columns
            if k == 1:
                assert sorted(str(r.doc_id) for r in docs.collect()) == ids
        assert (docs.count() > 0) == bool(ids)
