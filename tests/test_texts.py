"""Romanising, sanitising, portable files and probes, against rules and small cases."""

import gzip
import json
import random

from pyspark.sql import functions as F

from lectern.functions.romanize import ALPHABET, romanize, romanized
from lectern.functions.sanitize import sanitize, sanitized
from lectern.operators import probes
from lectern.sources import portable


def test_romanize_keeps_to_its_alphabet():
    for point in [*range(0x20, 0x3000), *range(0xFB00, 0xFEFF), *range(0xFF00, 0xFFF0)]:
        chars, source = romanize(chr(point) * 2)
        assert set(chars) <= ALPHABET and len(chars) == len(source) and source == sorted(source)


def test_romanize_scripts():
    assert romanize("Straße Ærø")[0] == "strasseaero"
    assert romanize("Чехов Щука")[0] == "chekhovshchuka"
    assert romanize("Ψυχή")[0] == "psychi"
    assert romanize("ג׳ שלום")[0] == "jshlvm"
    assert romanize("كتاب")[0] == "ktab"
    assert romanize("ﬁne ＡＢ")[0] == "fineab"
    assert romanize("'tis ‘don’t’ 5")[0] == "tis'don't"
    assert romanize("a ж") == ("azh", [0, 2, 2])
    assert romanize(None) == ("", [])


def test_romanized_column(spark):
    got = spark.createDataFrame([("Ça va",), (None,), ("",)], "t string").select(romanized(F.col("t")).alias("r")).collect()
    assert [(r.r.chars, r.r.source) for r in got] == [("cava", [0, 1, 3, 4]), ("", []), ("", [])]


def test_sanitize():
    page = """<html><head><title>x</title><style>p{}</style></head><body onload="a()"><p id="a1" style="x" class="c" onclick="e()">One <font>two</font><script>bad()</script>
<!-- no --><p>Three &amp; &lt;four&gt;<br>five<svg><text>s</text></svg></p><img src="../i/a b.png" alt="A"><img src="http://x/y.png"><a href="b.xhtml#f">in</a>
<a href="https://x.org">out</a><a href="javascript:x()">js</a><form><p>gone</p></form></body></html>"""
    got = sanitize(page, "text/a.xhtml", {"i/a b.png", "text/b.xhtml"})
    assert '<p id="a1" class="c">One two' in got["html"] and "bad()" not in got["html"] and "gone" not in got["html"] and "on" + "click" not in got["html"]
    assert "Three &amp; &lt;four&gt;<br>five</p>" in got["html"] and "Three & <four>\nfive\n" in got["text"]
    assert got["assets"] == ["i/a b.png"] and got["anchor_ids"] == ["a1"] and 'src="asset/i%2Fa%20b.png"' in got["html"] and "http://x/y" not in got["html"]
    assert '<a data-rp-href="text/b.xhtml#f" href="#">in</a>' in got["html"] and 'target="_blank">out</a>' in got["html"] and "<a>js</a>" in got["html"]
    assert sanitize(None) == {"html": "", "text": "", "assets": [], "anchor_ids": []}
    assert sanitize('<p>a<b>b<p title="&quot;x">c')["html"].count("<p") == 2


def test_sanitize_is_stable():
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<script>", "</script>", "<b onclick=x>", "</b>", "text", "&lt;script&gt;", "<li>", "<img src=x>", "<svg/onload=y>", "</div>", "<a href='javascript:z'>", "<", ">"]
    for _ in range(500):
        once = sanitize("".join(rng.choices(bits, k=12)))["html"]
        assert sanitize(once)["html"] == once and "<script" not in once and "<svg" not in once and " on" not in once.replace("&lt;", "")


def test_sanitized_column(spark):
    df = spark.createDataFrame([("<p>a</p>", "c.xhtml", ["x"]), (None, None, None)], "h string, c string, k array<string>")
    assert [r.clean.text for r in sanitized(df, "h", "c", "k").collect()] == ["a\n", ""]


def document(**changes):
    doc = {"format": "tag", "formatVersion": 1, "pairKey": "k" * 24, "ebook": {"textFingerprint": "t1:a"}, "audio": {"timelineFingerprint": "a1:b"}, "segmentCount": 1}
    doc["segments"] = {"sentenceIds": ["s"], "spineIdx": [0], "sentenceOrd": [0], "startMs": [5], "endMs": [9], "confidence": [0.5], "source": ["exact"], "uncertaintyMs": [0]}
    for path, value in changes.items():
        at, parts = doc, path.split("__")
        for p in parts[:-1]:
            at = at[p]
        at[parts[-1]] = value
    return gzip.compress(json.dumps(doc).encode())


def test_portable_reasons(spark):
    cases = {
        None: document(), "not-gzip": b"plain", "not-json": gzip.compress(b"{"), "not-object": gzip.compress(b"[1]"), "no-format": document(format=3), "other-format": document(format="x"),
        "no-version": document(formatVersion="1"), "newer-version": document(formatVersion=2), "shape": document(segments__startMs=[-1]), "text-scheme": document(ebook__textFingerprint="t9:"),
        "timeline-scheme": document(audio__timelineFingerprint="z"), "ragged:endMs": document(segments__endMs=[1, 2]),
    }
    more = [("shape", document(segments__confidence=[1.5])), ("shape", document(segments__spineIdx=["0"])), ("shape", document(segments=3)), ("not-gzip", document()[:-9]), ("not-gzip", None)]
    rows = [*cases.items(), *more, (None, document(segments__confidence=[1]))]
    got = portable.decoded(spark.createDataFrame(rows, "want string, content binary"), "tag").select("want", "reason", "segments").collect()
    assert [r.reason for r in got] == [r.want for r in got] and len(got) == len(rows)
    assert all((r.segments is None) == (r.reason is not None) for r in got) and got[0].segments[0].startMs == 5


def test_portable_round_trip(spark, tmp_path):
    rows = [("a" * 24, "Zoë", "One/Two", [("s0", 0, 0, 1, 2, 0.5, "exact", 0), ("s1", 0, 1, 3, 4, 1.0, "fuzzy", 7)]), ("b" * 24, None, None, [])]
    seg = ", ".join(f"{n}: {k}" for n, k in portable.COLUMNS.items())
    df = spark.createDataFrame(rows, f"key string, author string, title string, s array<struct<{seg}>>")
    pairs = df.withColumn("json", portable.document("tag", F.col("key"), F.lit("t1:x"), F.lit("a1:y"), F.col("s")))
    folder = tmp_path / "out"
    first = portable.write(pairs, str(folder)).collect()
    assert sorted(r.name for r in first) == [f"Unknown Author - Untitled [{'b' * 12}].rpalign", f"Zoe - One Two [{'a' * 12}].rpalign"]
    portable.write(pairs.withColumn("title", F.lit("New")), str(folder)).collect()
    (folder / ".hidden.rpalign").write_bytes(b"")
    files = portable.listed(spark, str(folder))
    assert [r.name for r in files.select("name").collect()] == [f"Unknown Author - New [{'b' * 12}].rpalign", f"Zoe - New [{'a' * 12}].rpalign"]
    assert files.filter(portable.of_pair(files, F.lit("a" * 24))).count() == 1
    read = {r.name[:3]: r for r in portable.decoded(files, "tag").select("name", "reason", "segments").collect()}
    assert [tuple(s) for s in read["Zoe"].segments] == rows[0][3] and read["Unk"].segments == [] and read["Unk"].reason is None


PLAN = probes.Plan(window_ms=1000, every_ms=9000)


def test_probes_go_to_odd_stretches():
    even = [(t, t // 10) for t in range(0, 60_001, 3000)]
    assert probes.place(even, [], 60_000, 9, PLAN) == []
    odd = [(t, p + 5000 * (t > 30_000)) for t, p in even]
    assert probes.place(odd, [], 60_000, 9, PLAN) == [(31_000, 1000)]
    assert probes.place(odd, [(31_000, 1000)], 60_000, 9, PLAN) == [(30_000, 1000)]
    assert probes.place([(20_000, 10)], [], 60_000, 9, PLAN) == [(39_500, 1000), (9_500, 1000)]
    assert probes.place([(20_000, 10)], [], 60_000, 1, PLAN) == [(39_500, 1000)]
    assert probes.place([], [], 60_000, 9, PLAN) == [] == probes.place([(20_000, 10)], [(0, 60_000)], 60_000, 9, PLAN)


def test_probes_never_overlap():
    rng = random.Random(2)
    for _ in range(200):
        audio = rng.randrange(5_000, 90_000)
        anchors = sorted((rng.randrange(audio), rng.randrange(9000)) for _ in range(rng.randrange(1, 8)))
        covered = [(t, min(1000, audio - t)) for t in range(0, audio, 9000)]
        made = probes.place(anchors, covered, audio, 20, PLAN)
        spans = sorted((s, s + d) for s, d in covered + made)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(s + d <= audio for s, d in made)


def test_probe_rounds(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    books = spark.createDataFrame([(1, 60_000), (2, 5_000), (3, 0)], "key bigint, audio_ms bigint")
    heard = lambda w: w.filter("start_ms between 20000 and 40000").select("key", F.col("start_ms").alias("ms"), (F.col("start_ms") / 10).cast("bigint").alias("pos"))
    got = [tuple(r) for r in probes.rounds(books, heard, PLAN).orderBy("key", "round", "start_ms").collect()]
    assert [r for r in got if r[0] == 2] == [(2, 0, 1000, 0)] and not [r for r in got if r[0] == 3]
    first, more = [r for r in got if r[0] == 1 and r[3] == 0], [r for r in got if r[0] == 1 and r[3] > 0]
    assert len(first) == 7 and 0 < len(more) <= 4 and len({r[1] for r in got if r[0] == 1}) == len(first) + len(more)
