import hashlib

from creditlake.llm import warc as W

HUGE = "x" * 70_000


def expected(rows, least=1000):
    big = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least and i is not None:
            big[p] = max(big.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        r = big.get(p)
        again = r is not None and r != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", r if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [(1, "u", "a" * 2000), (2, "u", "a" * 2000), (9, None, "a" * 2000), (3, "u\r\nx: y", "short"), (4, "u", "short"), (5, "u", None),
        (6, "u", ""), (7, "u", "é" * 600), (8, "u", "é" * 600), (10, "u", INNER), (11, "u", "pre " + INNER * 3 + " post"),
        (12, "u", "WARC/1.1\r\n" * 4), (13, "u", "\r\n\r\nContent-Length: 3\r\n\r\n"), (14, "u", HUGE), (15, "u", HUGE), (None, "u", "b" * 1500),
        (16, "u", "b" * 1500), (17, "u", "c" * 999), (18, "u", "c" * 999), (19, "u", "d" * 1000), (19, "u", "d" * 1000), (20, "u", "WARC/1.1\r"),
        (-21, "u", INNER * 40), (22, "u", INNER * 40), (23, "u", INNER + "\r\n\r\nWARC/1.1\r\nContent-Length: 999999999999999999999\r\n\r\n")]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "z", 0) for r in ROWS], "page_id long, url string, html string, record_type string, offset int")
    assert got(W.archived(df.coalesce(1))) == expected(ROWS)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4096", "513"):  # byte ranges that cut records anywhere
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            assert got(W.archived(df.repartition(2, "page_id"), max_records=9)) == expected(ROWS)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_are_plain_warc(spark, tmp_path):
    path = str(tmp_path / "w")
    W.write_archives(spark.createDataFrame(ROWS[:6], "page_id long, url string, html string").coalesce(1), path)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    at = n = 0
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert rest[size:size + 4] == b"\r\n\r\n"
        at += len(head) + 4 + size + 4
        n += 1
    assert n == 6


def test_broken_link_ends_the_chain(spark, tmp_path):
    rec = lambda i, body, told=None: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body) if told is None else told}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((rec(1, "one") + rec(2, "two") + rec(3, "three", 4) + rec(4, "four")).encode())
    (tmp_path / "b.warc").write_bytes((rec(5, rec(6, "inner")) + rec(7, "")).encode())
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(b"no archive")
    assert sorted(r.page_id for r in W.read_archives(spark, str(tmp_path)).collect()) == [1, 2, 3, 5, 7]


def test_empty_table(spark):
    assert W.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
