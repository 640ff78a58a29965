"""Folders of books and archives, made here."""

import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from lectern.sources import files


def book(toc="nav", spine=True, extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        nav = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if toc == "nav" else '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
        refs = '<itemref idref="c1"/><itemref idref="c2" linear="no"/><itemref idref="c3"/><itemref idref="pic"/><itemref idref="gone"/>' if spine else ""
        z.writestr(
            "OPS/book.opf",
            '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> A  Title </dc:title><dc:creator>An Author</dc:creator><dc:language>en-GB</dc:language>'
            f'<dc:subject>One</dc:subject><dc:subject>Two</dc:subject></metadata><manifest>{nav}<item id="c1" href="text/ch%201.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="text/c2.xhtml" media-type="application/xhtml+xml"/>'
            f'<item id="c3" href="text/c3.xhtml" media-type="text/html"/><item id="pic" href="p.png" media-type="image/png"/></manifest><spine toc="ncx">{refs}</spine></package>',
        )
        z.writestr("OPS/nav.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="text/ch%201.xhtml#a">First</a></li><li><a href="text/c2.xhtml">Hidden</a></li><li><a href="text/c3.xhtml">Third</a></li></ol></nav></body></html>')
        z.writestr("OPS/toc.ncx", '<ncx xmlns="urn:n"><navMap><navPoint><navLabel><text>First</text></navLabel><content src="text/ch%201.xhtml"/><navPoint><navLabel><text>Third</text></navLabel><content src="text/c3.xhtml"/></navPoint></navPoint></navMap></ncx>')
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


def test_scan_group_and_hash(spark, tmp_path):
    deep = "/".join("abcdefghi")
    made = {"loose.mp3": b"x" * 10, "B 1/track 10.mp3": b"y" * 70_000, "B 1/track 2.mp3": b"z" * 200_000, ".hidden/a.mp3": b"h", "B 1/.part.mp3": b"h", "B 1/notes.txt": b"n", f"{deep}/too.mp3": b"d", "E/book.epub": b"e"}
    for rel, data in made.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(data)
    listed = files.scan(spark, str(tmp_path), files.AUDIO)
    assert {(r.rel, r.size, r.supported) for r in listed.select("rel", "size", "supported").collect()} == {
        ("loose.mp3", 10, True), ("B 1/track 10.mp3", 70_000, True), ("B 1/track 2.mp3", 200_000, True), ("B 1/notes.txt", 1, False), ("E/book.epub", 1, False),
    }

    def quick(rel):
        data, stat = made[rel], (tmp_path / rel).stat()
        return hashlib.sha256(f"{stat.st_size}:{stat.st_mtime_ns // 1_000_000}".encode() + data[:65536] + (data[-65536:] if len(data) > 65536 else b"")).hexdigest()[:32]

    got = {r.rel: (r["size"], r.hash, r.tracks) for r in files.audiobooks(listed).collect()}
    both = hashlib.sha256((quick("B 1/track 2.mp3") + quick("B 1/track 10.mp3")).encode()).hexdigest()[:32]
    assert got == {"loose.mp3": (10, quick("loose.mp3"), ["loose.mp3"]), "B 1": (270_000, both, ["B 1/track 2.mp3", "B 1/track 10.mp3"])}


def test_packages(spark, tmp_path):
    for name, raw in {"nav": book(), "ncx": book("ncx"), "empty": book(spine=False), "junk": b"no archive", "bomb": book(extra=[("big", b"0" * 5_000_000)])}.items():
        (tmp_path / f"{name}.epub").write_bytes(raw)
    got = {r.rel: r for r in files.packages(files.scan(spark, str(tmp_path), files.EBOOKS)).collect()}
    for name in ("nav.epub", "ncx.epub"):
        r = got[name]
        assert (r.title, r.author, r.language, r.subjects) == ("A Title", "An Author", "en-GB", ["One", "Two"])
        assert r.spine == ["OPS/text/ch 1.xhtml", "OPS/text/c3.xhtml"] and [(t.label, t.spine) for t in r.toc] == [("First", 0), ("Third", 1)] and r.error is None
    assert "no spine" in got["empty.epub"].error and "BadZipFile" in got["junk.epub"].error and "too much" in got["bomb.epub"].error


def test_archive_names():
    raw = book(extra=[("../out", b"1"), ("a/./b", b"first"), ("a/b", b"second")])
    found = files.entries(raw)
    assert found["a/b"] == b"first" and not any("out" in n for n in found)


def test_image_kind(spark):
    rows = spark.createDataFrame([(b"\xff\xd8\xff\xe0x",), (b"\x89PNG\r\n\x1a\nrest",), (b"GIF8",), (None,)], "c binary")
    assert [r[0] for r in rows.select(files.image_kind(F.col("c"))).collect()] == ["image/jpeg", "image/png", None, None]


def test_mounts_folders_and_check(spark, tmp_path):
    for rel in ("a.epub", "x/b.epub", "x/c.txt", "x/y/d.epub"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(b"12")
    at = [str(tmp_path / "x"), str(tmp_path / "x/y"), "/proc/fs", "/", "/app/data", "/procedures"]
    lines = spark.createDataFrame([(f"36 35 98:0 / {p} rw,noatime - ext3 /dev/root rw",) for p in [*at, at[0]]] + [("short",), ("",)], "value string")
    mounted = files.mounts(lines, ("/app",))
    assert sorted(r.path for r in mounted.collect()) == sorted([at[0], at[1], "/procedures"])
    listed = files.scan(spark, str(tmp_path), files.EBOOKS)
    got = {r.dir: (r.files, r.bytes, r.books, r.mounted, r.mounts_inside) for r in files.folders(listed, mounted, str(tmp_path)).collect()}
    assert got == {".": (1, 2, 1, False, 2), "x": (2, 4, 1, True, 1), "x/y": (1, 2, 1, True, 0)}
    assert {r.dir: r.mounted for r in files.folders(listed).collect()} == {".": False, "x": False, "x/y": False}
    assert files.check(listed).first().problem is None and files.check(listed.limit(0)).first().matches == 0 and files.check(listed.limit(0)).first().problem
