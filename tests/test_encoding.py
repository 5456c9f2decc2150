"""Encoding job: BOM and NUL tests natively, detection against a brute-force Python model."""

import unicodedata

from linesift.operators import encoding as enc

SAMPLES = {
    "ascii": b"plain ascii text\n",
    "utf8": "naïve café — ok\n".encode("utf-8"),
    "bom": b"\xef\xbb\xbf" + "mit BOM äö\n".encode("utf-8"),
    "cp932": "テスト一行目\n".encode("cp932"),
    "eucjp": "日本語のテキスト\n".encode("euc_jp"),
    "latin1": "façade élève\n".encode("latin-1"),
    "empty": b"",
    "nul": bytes([0xE3, 0x00, 0x41]),
    "utf16": b"\xff\xfe" + "hi".encode("utf-16-le"),
}


def frame(spark):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in SAMPLES.items()], "path string, content binary")


def test_bom_and_nul(spark):
    got = {r.path: (r.b.encoding, r.b.confidence, r.b.has_bom, r.bin) for r in
           frame(spark).select("path", enc.bom("content").alias("b"), enc.is_binary("content").alias("bin")).collect()}
    assert got["bom"][:3] == ("utf-8-sig", 1.0, True)
    assert got["utf16"][:3] == ("utf-16", 0.9, True)
    assert got["ascii"][:3] == ("utf-8", 0.0, False)
    assert got["nul"][3] and got["utf16"][3] and not got["utf8"][3]


def share(text, ranges):
    return sum(next((w for lo, hi, w in ranges if lo <= ord(ch) <= hi), 0.0) for ch in text) / len(text)


def model_confidence(text, encoding, content):
    """The stated rule, written out on its own: script share, ASCII, NFC and round-trip terms, clamped."""
    if text == "":
        return 0.0
    ja = [(0x3040, 0x30FF, 1.0), (0x4E00, 0x9FAF, 1.0), (0xFF00, 0xFFEF, 0.5)]
    scripts = {e: ja for e in ("utf-8", "utf-8-sig", "cp932", "shift_jis", "euc-jp")}
    scripts |= {e: [(0x4E00, 0x9FAF, 1.0), (0xF900, 0xFAFF, 1.0)] for e in ("gb18030", "gbk", "gb2312", "big5")}
    scripts |= {e: [(0xAC00, 0xD7AF, 1.0), (0x1100, 0x11FF, 1.0)] for e in ("euc-kr", "cp949")}
    terms = [-0.3 * (len(text) + 1) / len(text), 0.4 * share(text, scripts.get(encoding, []))]
    terms.append(0.1 if max(text) < "\x80" else 0.0)
    terms.append(0.2 if len(unicodedata.normalize("NFC", text)) == len(text) else 0.0)
    try:
        terms.append(0.2 if len(text.encode(encoding)) == len(content) else 0.0)
    except UnicodeError:
        terms.append(-0.1)
    total = 0.0
    for term in terms:  # one after the other: sum() compensates rounding, which would break exact ties
        total += term
    return min(1.0, max(0.0, total))


def model_detect(content, encodings):
    if not content:
        return "utf-8"
    if content.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    best, conf = "utf-8", 0.0
    for e in encodings:
        try:
            text = content.decode(e)
        except (UnicodeError, LookupError):
            continue
        c = model_confidence(text, e, content)
        if c > conf:
            best, conf = e, c
    return best


def test_detect_matches_model(spark):
    for encodings in (enc.ENGINE_ENCODINGS, enc.OFFICE_ENCODINGS):
        got = {r.path: r.encoding for r in enc.detect(frame(spark), encodings, prefer_utf8=False).collect()}
        want = {k: model_detect(v, encodings) for k, v in SAMPLES.items()}
        assert got == want


def test_decode_one_encoding_per_file(spark):
    files = frame(spark).where(~enc.is_binary("content"))
    dec = {r.path: (r.encoding, r.text) for r in enc.decode(files).collect()}
    assert dec["cp932"] == ("cp932", "テスト一行目\n")
    assert dec["bom"][1] == "mit BOM äö\n" and dec["utf8"][1] == "naïve café — ok\n"
    lines = enc.decoded_lines(enc.decode(files)).where("path = 'cp932'").collect()
    assert [(r.line_number, r.raw) for r in lines] == [(1, "テスト一行目\n")]


def test_script_ratio(spark):
    df = spark.createDataFrame([("あア漢ａb",)], "text string")
    r = enc.script_ratios(df).collect()[0]
    assert (r.jp2, r.zh, r.ko, r.n) == (7, 1, 0, 5) and abs(r.japanese - 3.5 / 5) < 1e-12


def test_lenient_decoding(spark):
    rows = {"bad": b"\xef\xbb\xbfab\xff", "cp932": SAMPLES["cp932"], "bom": SAMPLES["bom"]}
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()], "path string, content binary")
    got = {r.path: r for r in enc.decode_lenient(files).collect()}
    assert (got["bom"].text, got["bom"].success, got["bom"].errors) == ("mit BOM äö\n", True, [])
    assert got["cp932"].text == "テスト一行目\n" and not got["cp932"].has_replacement_chars
    bad = got["bad"]
    assert (bad.encoding_used, bad.text, bad.success, bad.errors) == ("utf-8", "\ufeffab\ufffd", True, [enc.NOT_VALID])
    only = enc.decode_lenient(files, ["utf-8-sig"]).where("path = 'bad'").collect()[0]
    assert not only.success and only.has_replacement_chars and only.errors == [enc.NO_OTHER]


def test_undecodable_file_is_an_error_row(spark):
    files = spark.createDataFrame([("x", bytearray(b"\xff\xff\xff"))], "path string, content binary")
    r = enc.decode(files, ["utf-8"]).collect()[0]
    assert (r.encoding, r.text) == (None, None) and "no candidate" in r.error
