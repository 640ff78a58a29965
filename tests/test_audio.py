"""A prober's JSON, read."""

from lectern.sources import audio


def test_probe(spark):
    whole = """{"format": {"duration": "61.2345", "tags": {"Title": "T", "COMPOSER": "C", "genre": " Crime; Crime / Old ,,", "year": "c. 1999", "x": "y"}},
      "streams": [{"codec_type": "video", "codec_name": "png", "disposition": {"attached_pic": 1}}, {"codec_type": "audio", "codec_name": "mp3"}],
      "chapters": [{"start_time": "0.000", "end_time": "30.5", "tags": {"TITLE": "One"}}, {"start_time": "30.5"}]}"""
    texts = [whole, "{}", '{"format": {"tags": {"date": "0123", "artist": "A", "album_artist": "B", "narrator": "N", "genre": "%s"}}}' % ("g" * 61), "not json", None, "", "[1]", '{"format": {"duration": "N/A"}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, json string")
    got = [r.probe for r in audio.probed(df, this_year=2024).orderBy("id").collect()]
    first = got[0]
    assert (first.duration_ms, first.title, first.artist, first.narrator, first.album, first.genres, first.year, first.codec, first.has_cover) == (61235, "T", "C", "C", None, ["Crime", "Old"], 1999, "mp3", True)
    assert [tuple(c) for c in first.chapters] == [("One", 0, 30500), (None, 30500, 0)]
    assert (got[1].duration_ms, got[1].title, got[1].genres, got[1].codec, got[1].has_cover, got[1].chapters) == (0, None, [], None, False, [])
    assert (got[2].artist, got[2].narrator, got[2].genres, got[2].year) == ("A", "N", [], None)
    assert got[3:7] == [None] * 4 and got[7].duration_ms == 0
    assert audio.probed(df.limit(0), this_year=2024).count() == 0
