import gzip
import hashlib
import random

from tapeloom.llm.warc import LoserTree, _order, archived, url_key

SCHEMA = "page_id bigint, url string, html string, head bigint, n bigint, payload string"
LONG = "<p>" + "é" * 60 + "</p>"
PAGES = [
    (4, "http://B.example.com/x?q=1#top", LONG), (2, "https://a.example.com/", LONG), (2, "https://a.example.com/", LONG),
    (9, None, None), (None, "no scheme", LONG), (6, "http://b.example.com/x\r\n\r\n?q", "short"), (7, "http://b.example.com/x", "short"),
    (8, "http://b.example.com/x", "WARC/1.1\r\n\r\n\r\nContent-Length: 3\r\n\r\n" * 9), (1, "", ""),
]


def test_records_come_back(spark):
    pages = spark.createDataFrame([(*p, 1, 2, "z") for p in PAGES], SCHEMA).repartition(4)
    got = archived(pages).collect()
    assert len(got) == len(PAGES)
    for r in got:
        html = next((p[2] or "").encode() for p in PAGES if p[0] == r.page_id)
        again = html == LONG.encode() and r.page_id != 2
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha256(html).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if again else ("response", None))
    order = [(r.url_key, r.captured_at) for r in sorted(got, key=lambda r: (r.index_part, r.index_pos))]
    assert order == sorted(order)
    assert archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_without_any_id_all_are_responses(spark):
    got = archived(spark.createDataFrame([(None, "http://x.y/", LONG, 1, 2, "z")] * 3, SCHEMA)).collect()
    assert [r.record_type for r in got] == ["response"] * 3


def test_archives_are_plain_warc(spark, tmp_path):
    archived(spark.createDataFrame([(*p, 1, 2, "z") for p in PAGES], SCHEMA), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.gz"))
    assert data.count(b"WARC-Record-ID: ") == len(PAGES) and data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_loser_tree_merges_any_runs():
    rng = random.Random(7)
    for k in range(9):
        runs = [sorted(((str(rng.randint(0, 5)), rng.randint(0, 9), rng.choice([None, 1, 2]), 0, "", "", None, str(n), m, 0) for m in range(rng.randint(0, 12))), key=_order) for n in range(k)]
        assert list(map(_order, LoserTree(runs))) == sorted(_order(r) for run in runs for r in run)


def test_url_keys():
    assert url_key("http://WWW.Example.com/a?b#c") == "com,example,www)/a?b"
    assert url_key("mailto:x") == "" and url_key("x://h") == "h)"
