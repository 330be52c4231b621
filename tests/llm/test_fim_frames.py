import hashlib
import random
import re

from creditlake.llm import fim_frames as X

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, form, len(pre), len(mid), sha(out), sha(text)


def texts():
    rnd = random.Random(5)
    signs = ["a", "Z", "bcd", " ", "\n", "é", "漢", "😀", "<", ">", "P", "S", "M", "<P", "S>", "1", "\x00", "\r\n", "ß", "K"]
    out = [None, "", "a", "é", "😀", "<P>", "x <M> y", "<S", "letters" * 500, "漢" * 700, "<" * 300, "P>" * 300, "a" * 5000 + " " + "b" * 5000]
    for n in range(400):
        out.append("".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 200))))
    return out


def run(spark, rows, frame_bytes):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, frames string, units int")
    stored = X.store(df.repartition(3), frame_bytes=frame_bytes)
    got = X.digests(X.transform(stored, frame_bytes=frame_bytes)).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_like_brute_force_at_any_frame_size(spark):
    rows = list(enumerate(texts())) + [(7, "twice"), (7, "twice"), (None, "no id at all here"), (-3, "minus three <")]
    want = sorted((expected(i, t) for i, t in rows), key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    for size in (1, 3, 7, 64, X.FRAME_BYTES):
        assert run(spark, rows, size) == want


def test_only_the_cut_frames_are_opened():
    text = ("word " * 1000).encode()
    frames, units, chars = X.frames_of(text, 100)
    at = X.sizes(frames)
    bad = [f if k == 20 else b"damaged" for k, f in enumerate(frames)]
    assert X.place(units[20] + 3, bad, at, units, chars) == (len("word " * 401) + 4, len("word " * 401) + 4) or X.place(units[20] + 3, bad, at, units, chars)[0] // 100 == 20
    assert b"".join(X.stream(bad, at, 2000, 2100)) == text[2000:2100]
    assert b"".join(X.stream(frames, at, 0, at[-1])) == text


def test_very_long_text_and_plain_output(spark):
    long = "Wörter und 漢字 <P " * 100_000
    df = spark.createDataFrame([(3, long), (4, None)], "doc_id long, text string")
    assert sorted(map(tuple, X.digests(X.fill_in_middle(df)).collect())) == [expected(3, long), expected(4, None)]
    out = {r.doc_id: (r.form, r.output) for r in X.texts(X.fill_in_middle(df)).collect()}
    assert hashlib.sha256(out[3][1].encode()).hexdigest() == expected(3, long)[5] and out[4] == ("plain", "")


def test_empty_table(spark):
    assert X.digests(X.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
