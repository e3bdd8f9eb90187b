"""Prompts, images and replayed attempts against plain Python."""

import base64
import json
import random
import struct
import zlib

from pyspark.sql import functions as F

from scoreloom.functions import images, prompts
from scoreloom.operators import attempts, quality
from scoreloom.sources import readers, sinks
from scoreloom.sources.shared import shared_dir


def plain_replay(rows, max_tokens=None):
    out = {"attempts": 0, "answer": None, "status": None, "error": None, "max_tokens": max_tokens, "waited": 0.0, "tokens": 0, "latency_ms": 0.0, "warnings": []}
    asked = False
    for status, finish, answer, warning, tokens, latency in rows:
        out["attempts"] += 1
        more = out["attempts"] < 5
        out["tokens"] += tokens or 0
        out["latency_ms"] += latency or 0.0
        out["status"] = status
        if status != 200:
            out["warnings"].append(f"http_status_{status}")
            if status in attempts.RETRYABLE and more:
                out["waited"] += [2.0, 4.0, 8.0][min(out["attempts"] - 1, 2)]
                continue
            out["error"] = f"http_error_{status}"
            break
        out["answer"] = answer
        if answer is None and more and (finish or "").lower() in ("length", "max_tokens", "max_tokens_exceeded"):
            after = 256 if out["max_tokens"] is None else min(out["max_tokens"] * 2, 4096)
            out["warnings"].append(f"max_tokens_retry_{'auto' if out['max_tokens'] is None else out['max_tokens']}->{after}")
            out["max_tokens"] = after
            continue
        if warning:
            out["warnings"].append(warning)
        if answer is None and warning in ("no_parse", "empty_response") and not asked and more:
            asked = True
            out["warnings"].append(f"retry_due_to_{warning}")
            continue
        break
    return out


def test_replayed(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for item in range(400):
        tries = []
        for _ in range(rng.randint(1, 8)):
            answer = rng.choice([None, None, None, "A", "DECLINED"])
            tries.append((rng.choice([200, 200, 200, 200, 429, 503, 400]), rng.choice([None, "stop", "length", "MAX_TOKENS"]), answer, None if answer else rng.choice([None, "no_parse", "empty_response"]), rng.choice([None, 10, 20]), rng.choice([None, 1.5, 2.0])))
        rows += [(item, i, *t) for i, t in enumerate(tries)]
        want[item] = tries
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "item int, place int, status int, finish string, answer string, warning string, tokens bigint, latency_ms double")
    for most in (None, 1500):
        got = {r.item: r.asDict() for r in attempts.replayed(frame, ["item"], "place", most).collect()}
        assert {k: {c: v[c] for c in v if c != "item"} for k, v in got.items()} == {k: plain_replay(v, most) for k, v in want.items()}


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    big = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 4000, 480)
    jpeg = b"\xff\xd8\xff\xe0\x00\x10" + b"J" * 14 + b"\xff\xdb\x00\x04aa" + b"\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 300, 200) + b"\x01"
    gif = b"GIF89a" + struct.pack("<HH", 20, 30)
    cases = [(png, (640, 480)), (big, (4000, 480)), (jpeg, (200, 300)), (gif, (20, 30)), (b"no image at all", (None, None)), (b"\xff\xd8\xff\xff\xff", (None, None)), (b"\x89PNG", (None, None)), (None, (None, None))]
    rows = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, (d, _) in enumerate(cases)], "id int, data binary")
    got = {r.id: r for r in rows.select("id", images.image_size("data").alias("size"), images.message_image("data").alias("m")).collect()}
    for i, (data, size) in enumerate(cases):
        assert (got[i].size.width, got[i].size.height) == size
    assert got[0].m.url == "data:image/png;base64," + base64.b64encode(png).decode() and got[0].m.warning is None
    assert got[2].m.url.startswith("data:image/jpeg;base64,") and got[3].m.url.startswith("data:image/gif;base64,")
    assert (got[1].m.url, got[1].m.warning) == (None, "image_too_large") and got[4].m.warning == got[5].m.warning == got[6].m.warning == "image_decode_failed"
    assert (got[7].m.url, got[7].m.warning) == (None, None)
    texts = spark.createDataFrame([(base64.b64encode(png).decode(),), ("QUJD",), ("not base64, but long",), (None,)], "t string")
    assert [None if r[0] is None else bytes(r[0]) for r in texts.select(images.image_bytes("t", "string")).collect()] == [png, None, None, None]


def test_messages(spark):
    rows = spark.createDataFrame([('Wie "viel"?', None, "1", None, "q", ["a", None, "c"], "o"), ("How\nmany?", "EN", "", "2", None, None, None), (None, "fr", "1", "2", "", [], "")], "q string, lang string, a string, b string, qu string, more array<string>, bu string")
    options = {x: F.lit("x") for x in "CDE"} | {"A": F.col("a"), "B": F.col("b")}
    got = [json.loads(r[0]) for r in rows.select(prompts.messages(F.col("q"), F.col("lang"), options, F.col("qu"), F.col("more"), {"B": F.col("bu")})).collect()]
    image = lambda url: {"type": "image_url", "image_url": {"url": url, "detail": "auto"}}
    text = lambda t: {"type": "text", "text": t}
    de, en = prompts.TEXTS["de"], prompts.TEXTS["en"]
    assert [m["role"] for m in got[0]] == ["system", "user"] and got[0][0]["content"] == "\n".join(de["system"]) and got[1][0]["content"] == "\n".join(en["system"])
    assert got[0][1]["content"] == [
        text('Frage: Wie "viel"?'), text("Fragebild:"), image("q"), text("Zusatzbild 1:"), image("a"), text("Zusatzbild 3:"), image("c"), text("Antwortmöglichkeiten:"), text("A) 1"), text("B) "), text("Option B Bild:"), image("o"),
        text("C) x"), text("D) x"), text("E) x"), text(de["last"]),
    ]
    assert got[1][1]["content"] == [text("Question: How\nmany?"), text("Answer choices:"), text("A) "), text("B) 2"), text("C) x"), text("D) x"), text("E) x"), text(en["last"])]
    assert got[2][1]["content"][0] == text("Question:") and len(got[2][1]["content"]) == 8


def png_of(width, height, depth=8, colour=2, interlaced=0, lines=None):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = lines if lines is not None else (b"\0" + bytes(range(256)) * 99)[: 1 + -(-width * depth * channels // 8)] * height
    packed = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


def test_images_read_to_their_end(spark):
    good = png_of(30, 20)
    jpeg = b"\xff\xd8\xff\xe0\x00\x10" + b"J" * 14 + b"\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01aaa" + b"\xff\xda\x00\x04aa" + b"scan"
    seven = sum((1 + w * 3) * h for w, h in ((1, 1), (1, 1), (2, 1), (2, 2), (4, 2), (4, 4), (8, 4)))
    cases = [
        (good, True), (good[:-1], False), (good[:-12], False), (good[:60], False), (good[:40] + b"?" + good[41:], False), (png_of(30, 20, lines=b"\0" * 50), False), (png_of(9, 2, 1, 0), True),
        (good[:25] + b"\x05" + good[26:], False), (png_of(8, 8, interlaced=1, lines=b"\0" * seven), True), (png_of(8, 8, interlaced=1, lines=b"\0" * (seven - 1)), False),
        (jpeg + b"\xff\xd9", True), (jpeg, False), (b"\xff\xd8\xff\xd9", False), (b"GIF89a\x01\x00\x01\x00;", True), (b"GIF89a\x01\x00\x01\x00", False), (b"no image", False), (b"", False), (None, None),
    ]
    rows = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, (d, _) in enumerate(cases)], "i int, data binary").repartition(5)
    assert {r.i: r.ok for r in rows.select("i", images.decodes("data").alias("ok")).collect()} == {i: ok for i, (_, ok) in enumerate(cases)}


def test_first_images_in_order(spark):
    """Of images in many partitions the first ones in order are decoded, whatever is between them."""
    good, bad = png_of(3, 3), png_of(3, 3)[:-1]
    rows = [(i, p, None if (i + p) % 5 == 0 else bytearray(bad if i % 7 == 0 else good)) for i in range(300) for p in range(3)]
    frame = spark.createDataFrame(rows, "row int, place int, data binary").repartition(17)
    first = [r for r in rows if r[2] is not None]
    for limit in (1, 50, 400, 5000):
        got = {(r["row"], r.place) for r in quality.decode_issues(frame, "row", "place", limit=limit).collect()}
        assert got == {r[:2] for r in first[:limit] if bytes(r[2]) == bad}
    plan = quality.decode_issues(frame, "row", "place")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_snapshots(spark):
    """Runs of one write are there together; a write that died before its manifest shows none, one that came again the last."""
    top = shared_dir(spark, "runs")
    rows = lambda *x: spark.createDataFrame([(r, (n, 0.5), ("m",)) for r, n in x], "run_id string, metrics struct<answered_count:bigint,accuracy:double>, config struct<model_id:string>")
    sinks.snapshots(rows(("20240101", 1), ("b/c é", 2)), top)
    spark.createDataFrame([('{"answered_count":9}', "x", "metrics")], "value string, run_id string, file string").write.partitionBy("run_id", "file").text(f"{top}/snapshots/part=dead")
    read = lambda: {r.run_id: (r.metrics.answered_count, r.config.model_id) for r in readers.snapshots(spark, top).collect()}
    assert read() == {"20240101": (1, "m"), "b/c é": (2, "m")}
    sinks.snapshots(rows(("20240101", 5)), top)
    assert read() == {"20240101": (5, "m"), "b/c é": (2, "m")}
