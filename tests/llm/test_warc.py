import base64
import hashlib

import pytest

from tarnwork.llm import warc_zstd as w
from tests.llm.conftest import SF


def frame(data, dictionary=None):
    import zstandard

    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(dict_data=own).compress(data)


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, refers_to int, kept string")


def test_round_trip_equals_brute_force(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows += [(-1, "u", None), (-2, None, ""), (-3, "a b\n", "é same"), (-4, "z", "é same"), (-5, "z", "é same"), (-9, "long", "<p>x" * 200_000)]
    got = w.round_trip(make(spark, rows)).collect()
    assert len(got) == len(rows)
    payload = {i: (html or "").encode() for i, _, html in rows}
    largest = {}
    for i, data in payload.items():
        largest[data] = max(largest.get(data, i), i)
    for r in got:
        data = payload[r["page_id"]]
        kept = largest[data]
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r["record_type"] == ("response" if kept == r["page_id"] else "revisit")
        assert r["refers_to"] == (None if kept == r["page_id"] else kept)
        assert r["payload"] == (data if kept == r["page_id"] else None)


def test_nulls_repeats_small_payloads_and_no_pages(spark):
    pages = make(spark, [(None, "n", "same"), (1, "x", "same"), (2, "x", "same"), (2, "x", "same")])
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in w.round_trip(pages).collect())
    assert got == [(0, "response", None), (1, "revisit", 2), (2, "response", None), (2, "revisit", 2)]
    assert {r["record_type"] for r in w.round_trip(pages, min_bytes=5).collect()} == {"response"}
    assert w.round_trip(pages.where("page_id = 9")).count() == 0


def test_reader_uses_the_dictionary_and_one_frame_per_record():
    import zstandard

    samples = [f"<html><body>page {i} with the same words again</body></html>".encode() * 3 for i in range(800)]
    dictionary = zstandard.train_dictionary(4096, samples).as_bytes()
    data = [w.record(i, "u", s, w.sha1_base32(s), None) for i, s in enumerate(samples[:20])]
    archive = w.dictionary_frame(dictionary) + b"".join(frame(d, dictionary) for d in data)
    assert list(w.records(archive)) == data
    assert [w.parsed(d)["payload"] for d in w.records(archive)] == samples[:20]
    with pytest.raises(zstandard.ZstdError):
        list(w.records(w.dictionary_frame(b"") + archive[len(w.dictionary_frame(dictionary)) :]))


def test_bad_archives_and_records_are_refused():
    good = w.record(1, "u", b"abc", w.sha1_base32(b"abc"), None)
    assert w.parsed(good)["payload"] == b"abc"
    archive = w.dictionary_frame(b"") + frame(good)
    for bad in (frame(good), archive[:-3], archive + b"rest", w.dictionary_frame(b"")[:5]):
        with pytest.raises(ValueError):
            list(w.records(bad))
    for old, new in (
        (b"WARC/1.1", b"WARC/9.9"), (b"abc", b"abd"), (b"WARC-Type: response", b"WARC-Type: other"),
        (b"WARC-Date", b"X-Date"), (b"\r\n\r\nabc", b"\r\n\r\nabcd"), (b"Content-Length: 3", b"Content-Length: 4"),
    ):
        with pytest.raises(ValueError):
            w.parsed(good.replace(old, new))


def test_pages_repeated_in_full_are_one_response(spark):
    rows = [(7, "u", "same " * 9)] * 30 + [(7, "v", "same " * 9), (8, "w", "same " * 9), (6, None, None), (6, None, None)]
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in w.round_trip(make(spark, rows)).collect())
    assert got == sorted([(6, "response", None), (6, "revisit", 6), (8, "response", None)] + [(7, "revisit", 8)] * 31)
    alone = [r for r in rows if r[0] == 7]
    kinds = [(r["record_type"], r["refers_to"]) for r in w.round_trip(make(spark, alone)).collect()]
    assert sorted(kinds, key=str) == sorted([("response", None)] + [("revisit", 7)] * 30, key=str)


SMALL_RESULTS = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from tarnwork.llm import warc_zstd
from tarnwork.session import get_session
spark = get_session(
    "small", spark__master="local[4]", spark__driver__memory="2g", spark__driver__maxResultSize="48m",
    spark__ui__enabled="false", spark__sql__shuffle__partitions="4",
)
spark.sparkContext.setLogLevel("ERROR")
html = F.concat(*(F.sha2(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(k))), 256) for k in range(130)))
pages = spark.range(0, 60_000, 1, 110).select(
    F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), F.col("id").cast("string")).alias("url"), html.alias("html")
)
print("dictionary", len(warc_zstd.train(pages)))
"""


def test_the_sample_does_not_grow_with_the_number_of_tasks(tmp_path):
    """110 tasks of 545 pages over 8 KB: 450 MB of starts, of which 16 MB may be sent."""
    import subprocess
    import sys

    from tests.conftest import ROOT

    script = tmp_path / "small.py"
    script.write_text(SMALL_RESULTS.format(root=ROOT))
    ran = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0 and int(ran.stdout.split("dictionary")[1]) > 1000, ran.stderr[-2000:]
