"""Scans, the page pipeline, sinks, resilience and run outcomes on small fixtures."""

import os
import random
import zlib
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import digests, images, results
from quire.operators import lines as line_ops
from quire.operators import order, pages, resilience, review
from quire.plans import further
from quire.sources import docx, pdf, png, scans, sinks


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (1, 1), (9, 4, 3), (3, 8, 4)):
        a = rng.integers(0, 256, shape, np.uint8)
        assert (png.decode(png.encode(a)) == a).all()


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    """Rows that a writer has filtered come back as they were."""
    a = np.random.default_rng(kind).integers(0, 256, (6, 9), np.uint8).astype(int)
    rows = b""
    for y in range(6):
        row = []
        for x in range(9):
            left, up, corner = (a[y, x - 1] if x else 0), (a[y - 1, x] if y else 0), (a[y - 1, x - 1] if x and y else 0)
            guess = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(guess - v))
            row.append((a[y, x] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        rows += bytes([kind, *row])
    assert (png._unfiltered(rows, 6, 9, 1) == a).all()
    assert zlib.decompress(zlib.compress(rows)) == rows


def test_tiff_frames_and_errors():
    frames = [np.full((2, 3), k, np.uint8) for k in range(3)]
    content = further._tiff(frames)
    assert all(error is None and (got == want).all() for (got, error), want in zip(png.tiff_frames(content), frames, strict=True))
    broken = bytearray(content)
    place = content.index((259).to_bytes(2, "little") + b"\4\0\1\0\0\0\1")
    broken[place + 8] = 5
    assert [error is None for _, error in png.tiff_frames(bytes(broken))] == [False, True, True]


def test_pdf_pages_and_hidden_text():
    gray = np.random.default_rng(1).integers(0, 256, (20, 30), np.uint8)
    content = pdf.write([{"width": 30, "height": 20, "image": png.encode(gray), "lines": [(1, 2, 3, 12, "Ἐν ἀρχῇ 😀"), (1, 2, 3, 12, "")]}, {"width": 10, "height": 10, "note": "[Page 2 (torn)]"}])
    file = pdf.File(content)
    assert len(file.pages) == 2 and file.hidden_text(file.pages[0]) == ["Ἐν ἀρχῇ 😀", ""]
    assert (png.decode(file.image(file.pages[0])[0]) == gray).all()
    with pytest.raises(ValueError):
        file.image(file.pages[1])
    assert (pdf.font_size(1), pdf.font_size(10), pdf.font_size(99)) == (4.0, 6.0, 12.0)
    with pytest.raises(ValueError):
        pdf.File(b"%PDF-1.7 nothing")


def test_scan_goes_on_after_errors(spark):
    rows = [("a.pdf", further._file(0)), ("b.pdf", b"%PDF nothing"), ("c.tif", further._file(2)), ("d.png", further._file(1)), ("e.jpg", b""), ("f.jpg", None)]
    got = scans.pages(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert [(r.path, r.page_no, r.error is None) for r in sorted(got)] == [
        ("a.pdf", 1, True), ("a.pdf", 2, False), ("b.pdf", 0, False), ("c.tif", 1, True), ("c.tif", 2, True), ("c.tif", 3, True), ("d.png", 1, True), ("e.jpg", 1, False), ("f.jpg", 1, False),
    ]
    counted = {r.path: r.pages for r in scans.count_pages(scans.pages(spark.createDataFrame(rows, "path string, content binary")), "path").collect()}
    assert counted == {"a.pdf": 2, "b.pdf": 1, "c.tif": 3, "d.png": 1, "e.jpg": 1, "f.jpg": 1}


def test_files_of_a_folder(spark, tmp_path):
    for name, data in (("1.png", b"x"), ("02.JPG", b"yy"), ("2.png", b"zzz"), ("note.txt", b"q")):
        (tmp_path / name).write_bytes(data)
    got = {r.page_no: bytes(r.content) for r in scans.numbered_images(scans.files(spark, str(tmp_path))).collect()}
    assert got == {1: b"x", 2: b"yy"}


def test_docx_round_trip():
    content = docx.write([([("a <b> & c", "heading"), ("x\x00y", "body")], None), ([], "torn")])
    assert docx.read(content) == (1, [("a <b> & c", "Heading1"), ("xy", ""), ("torn", "")])
    assert content == docx.write([([("a <b> & c", "heading"), ("x\x00y", "body")], None), ([], "torn")])


def test_image_chain_marks_errors(spark):
    gray = np.array([[0, 255], [130, 120]], np.uint8)
    df = spark.createDataFrame([(0, png.encode(gray)), (1, b"no image"), (2, png.encode(np.dstack([gray] * 3)))], "k int, c binary")
    got = df.select("k", images.chain("grayscale", "bilevel")("c").alias("r")).orderBy("k").collect()
    assert [r.r.error is None for r in got] == [True, False, True]
    assert all((png.decode(bytes(got[k].r.content)) == [[0, 255], [255, 0]]).all() for k in (0, 2))
    assert images.shrink(gray, 1).tolist() == [[126]]
    with pytest.raises(ValueError):
        images.crop(gray, 1, 1, 1, 2)


def _pipeline(spark, ports=pages.Ports()):
    box = "x long, y long, w long, h long"
    found = spark.createDataFrame([(1, 1, None), (1, 2, "torn"), (1, 3, None), (1, 4, None), (1, 5, None)], "doc_id long, page_no long, error string")
    embedded = spark.createDataFrame([(1, 3, 0, "p3-tl-l0", "grc", "own text", 0, 0, 9, 9)], "doc_id long, page_no long, line_idx int, line_id string, script string, text string, " + box)
    segments = spark.createDataFrame([(1, p, k, f"line-{k}", "grc", "main", k + 1, 0, 30 * k, 500, 24) for p in (1, 3, 5) for k in range(3)], "doc_id long, page_no long, seg_idx long, seg_id string, script string, region_type string, reading_order long, " + box)
    words = lambda page, engine, variant, text, conf, line: [(1, page, engine, engine, variant, 100 * line + k, w, conf, 60 * k, 30 * line + 2, 50, 20) for k, w in enumerate(text.split())]
    blocks = [
        *words(1, "a", "", "one two thre", 50.0, 0), *words(1, "b", "", "one tvo three", 90.0, 0), *words(1, "a", "otsu", "one two three", 99.0, 0), *words(1, "b", "otsu", "one two three", 10.0, 0),
        *words(1, "a", "", "same line", 10.0, 1), *words(1, "b", "", "same line", 20.0, 1),
    ]
    blocks = spark.createDataFrame(blocks, "doc_id long, page_no long, engine string, model_name string, variant string, block_idx long, text string, conf double, " + box)
    runs = [(1, p, e, v, o, 10 * o + n, "down" if p == 5 else None) for p in (1, 5) for n, e in enumerate("ab") for o, v in enumerate(("", "otsu"))]
    runs = spark.createDataFrame(runs, "doc_id long, page_no long, engine string, variant string, variant_ord int, run_ord int, error string")
    routes = spark.createDataFrame([("grc", 0, "a"), ("grc", 1, "b")], "script string, engine_ord int, engine string")
    lexicon = spark.createDataFrame([("grc", 0, w) for w in ("one", "two", "three", "same", "line", "own")], "lexicon string, layer int, form string")
    return pages.process_pages(found, embedded, segments, blocks, runs, routes, ["a"], lexicon, ports)


def test_page_pipeline(spark):
    out = _pipeline(spark)
    got = {(r.page_no, r.seg_idx): (r.line_id, r.text, r.engine, r.agreement) for r in out.lines.collect()}
    assert got == {
        # The primary reading of most confidence wins, however sure a variant is.
        (1, 0): ("p1-line-0", "one tvo three", "b", "majority"), (1, 1): ("p1-line-1", "same line", "b", "unanimous"), (1, 2): ("p1-line-2", "", None, "single"),
        (3, 0): ("p3-tl-l0", "own text", "pdf_text_layer", "single"),
        (5, 0): ("p5-line-0", "", None, "single"), (5, 1): ("p5-line-1", "", None, "single"), (5, 2): ("p5-line-2", "", None, "single"),
    }
    failures = {r.page_no: (r.error_type, r.message) for r in out.failures.collect()}
    assert failures == {
        2: ("IngestError", "torn"), 4: ("EmptyPage", "no text lines were produced for this page"),
        5: ("EngineError", "every engine failed on this page: a: down; b: down; a: down; b: down"),
    }
    found = spark.createDataFrame([(1, p) for p in range(1, 6)], "doc_id long, page_no long")
    assert sorted(r.page_no for r in out.clean_pages(found).collect()) == [1, 3]
    said = {(r.line_id, r.suggestion_text, r.reason) for r in out.suggestions.collect()}
    assert said == {("p1-line-0", "tvo", "not_in_grc_lexicon"), ("p3-tl-l0", "text", "not_in_grc_lexicon"), ("p1-line-0", "one two three", "alignment_merge")}


def test_page_pipeline_takes_plug_ins(spark):
    from quire.operators.reconcile import first_candidate

    first = pages.Ports(reconcile=lambda c: first_candidate(c, pages.SEGMENT), merge=None, assemble=lambda lines: lines.filter("text != ''"))
    got = {(r.page_no, r.seg_idx): r.engine for r in _pipeline(spark, first).lines.collect()}
    assert got == {(1, 0): "a", (1, 1): "a", (3, 0): "pdf_text_layer"}


def test_assembling_makes_no_failures(spark):
    """Pages fail by their layout and their engines; lines that a plug-in leaves out afterwards make no empty page."""
    some = _pipeline(spark, pages.Ports(merge=None, assemble=lambda lines: lines.filter("text != ''")))
    assert sorted((r.page_no, r.error_type) for r in some.failures.collect()) == [(2, "IngestError"), (4, "EmptyPage"), (5, "EngineError")]
    assert "MapInArrow" not in some.failures._jdf.queryExecution().executedPlan().toString()


def test_agreement_within_a_row(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(("a b", " a  b", "c", "", None))) for k in range(400) for _ in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "k long, text string")
    want = {r.k: r.agreement for r in line_ops.agreement(df, ["k"]).collect()}
    assert len(set(want.values())) == 4
    assert {r.k: r.t for r in df.groupBy("k").agg(F.collect_list(F.struct("text")).alias("a")).select("k", line_ops.tier(F.transform("a", lambda c: c["text"])).alias("t")).collect()} == want


def test_retries(spark):
    calls = [(1, 0, False, None, "x"), (1, 1, True, 5, None), (2, 0, False, None, "x"), (2, 1, False, None, "y"), (2, 2, True, 9, None), (3, 0, True, 7, None), (3, 1, True, 8, None)]
    got = resilience.retried(spark.createDataFrame(calls, "k int, attempt int, ok boolean, value int, error string"), ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, True, 5, None, 2), (2, False, None, "y", 2), (3, True, 7, None, 1)]


@pytest.mark.parametrize("size, ttl", [(1, None), (3, None), (3, 5.0), (100, 2.0)])
def test_cache(spark, size, ttl):
    import random

    rng = random.Random(size)
    calls = [(e, s, float(s) * 0.7, rng.choice("abcdef"), rng.random() < 0.8) for s in range(200) for e in "xy"]
    got = {(r.engine, r.seq): r.hit for r in resilience.cached(spark.createDataFrame(calls, "engine string, seq long, t double, key string, ok boolean"), size, ttl).collect()}
    for engine in "xy":
        kept = OrderedDict()
        for _, s, t, key, ok in sorted(c for c in calls if c[0] == engine):
            if key in kept and ttl is not None and t - kept[key] >= ttl:
                del kept[key]
            hit = key in kept
            assert got[engine, s] == hit
            if hit:
                kept.move_to_end(key)
            elif ok:
                kept[key] = t
                while len(kept) > size:
                    kept.popitem(last=False)


def test_replaced_folder_survives_a_failure(spark, tmp_path):
    folder = str(tmp_path / "out")
    sinks.replace_folder(spark.range(3), folder)
    with pytest.raises(Exception):
        sinks.replace_folder(spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id")), folder)
    assert spark.read.parquet(folder).count() == 3 and sorted(os.listdir(tmp_path)) == ["out"]
    sinks.replace_folder(spark.range(5), folder)
    assert spark.read.parquet(folder).count() == 5 and sorted(os.listdir(tmp_path)) == ["out"]


def test_training_export(spark, tmp_path):
    samples = spark.createDataFrame([("line-1.png", "ab", b"i1"), ("line-2.png", 'c "d"', b"i2")], "name string, text string, image binary")
    sinks.export_training(samples, str(tmp_path))
    assert (tmp_path / "images/line-1.gt.txt").read_text() == "ab\n" and (tmp_path / "images/line-2.png").read_bytes() == b"i2"
    assert [r.value for r in spark.read.text(str(tmp_path / "train.json")).collect()] == ['{"image":"images/line-1.png","text":"ab"}', '{"image":"images/line-2.png","text":"c \\"d\\""}']


def test_registry(spark, tmp_path):
    import hashlib

    rows = [("kraken", hashlib.sha256(b"w%d" % k).hexdigest() if k != 2 else "0" * 64, b"w%d" % k, "grc", 1.0, k) for k in range(3)] + [("kraken", "short", b"w", "grc", 1.0, 9)]
    sinks.register(spark.createDataFrame(rows, "engine string, model_hash string, content binary, script string, improvement_pct double, registered_at long"), str(tmp_path / "r"))
    got = sinks.promoted(spark.read.parquet(str(tmp_path / "r"))).collect()
    assert [(r.registered_at, r.file) for r in got] == [(1, hashlib.sha256(b"w1").hexdigest()[:16] + ".mlmodel")]
    with pytest.raises(Exception):
        spark.createDataFrame([(b"x", "short")], "c binary, d string").select(digests.verified(F.col("c"), F.col("d"))).collect()


def test_undo_restores_absence(spark):
    log = [("s", 0, "edited", "k", "a"), ("s", 1, "edited", "k", "a"), ("s", 2, "edited", "k", "b"), ("s", 3, "accepted", "k", "c"), ("s", 4, "accepted", "k", None), ("t", 0, "edited", "z", "q")]
    df = spark.createDataFrame(log, "session string, seq long, store string, key string, value string")
    after = lambda n: {(r.session, r.store, r.key): r.value for r in review.undone(df, n).collect()}
    # The second write changed nothing, so it is no step.
    assert after(1) == {("s", "edited", "k"): "b", ("s", "accepted", "k"): "c"}
    assert after(2) == {("s", "edited", "k"): "b"}
    assert after(3) == {("s", "edited", "k"): "a"}
    assert after(9) == {}


def test_next_free(spark):
    taken = [("a", n) for n in (1, 2, 4, 4, 0)] + [("b", n) for n in range(2, 9)] + [("c", n) for n in range(1, 3000)] + [("d", n) for n in range(1, 5000) if n != 2500] + [("e", None)] + [("f", n) for n in range(1, 1024)] + [("g", n) for n in (*range(1, 1024), *range(2048, 2100))]
    got = {r.prefix: r.next_id for r in pages.next_free(spark.createDataFrame(taken, "prefix string, n long")).collect()}
    assert got == {"a": "a-3", "b": "b-1", "c": "c-3000", "d": "d-2500", "e": "e-1", "f": "f-1024", "g": "g-1024"}


def test_numbered(spark, monkeypatch):
    monkeypatch.setattr(order, "WIDTH", 4)
    rows = [("x" if n % 3 else None, n * n) for n in range(40)]
    got = order.numbered(spark.createDataFrame(rows, "g string, n long"), F.col("g"), "n", "place").collect()
    for group in ("x", None):
        assert [r.place for r in sorted((r for r in got if r.g == group), key=lambda r: r.n)] == list(range(1, sum(g == group for g, _ in rows) + 1))


def test_results_keep_the_first_error(spark):
    n = results.checked(F.col("t").try_cast("int"), F.concat(F.lit("bad "), "t"), "int")
    half = results.and_then(n, lambda v: F.when(v % 2 == 0, results.ok((v / 2).cast("int"))).otherwise(results.err(F.lit("odd"), "int")), "int")
    again = results.map_err(results.mapped(half, lambda v: v + 1, "int"), lambda e: F.upper(e), "int")
    got = spark.createDataFrame([("8",), ("7",), ("x",)], "t string").select(again.alias("r"), results.unwrap_or(half, F.lit(-1)).alias("u")).collect()
    assert [(r.r.ok, r.r.value, r.r.error, r.u) for r in got] == [(True, 5, None, 4), (False, None, "ODD", -1), (False, None, "BAD X", -1)]


def test_exit_codes_and_models(spark):
    problem, job = spark.createDataFrame([("x",)], "p string"), spark.createDataFrame([(True,), (False,)], "ok boolean")
    code = lambda p, j: pages.exit_code(p, j).first().exit_code
    assert (code(problem, job), code(problem.limit(0), job), code(problem.limit(0), job.filter("ok")), code(problem.limit(0), job.limit(0))) == (3, 1, 0, 0)
    scripts, none = spark.createDataFrame([("grc",)], "script string"), spark.createDataFrame([], "script string, pos long, engine string, model string")
    manifest, files = spark.createDataFrame([("m", "kraken", True)], "name string, engine string, is_default boolean"), spark.createDataFrame([("a",), ("m",)], "name string")
    chosen = lambda *a, **k: pages.chosen_model(scripts, *a, **k).first().model
    assert chosen(none, manifest, files, explicit="z") == "z"
    assert chosen(none, manifest, files) == "m" and chosen(none, manifest, files.filter("name = 'a'")) == "a" and chosen(none, manifest, files.limit(0)) is None
    new = spark.createDataFrame([("grc", 1, "kraken", "old"), ("grc", 2, "kraken", "new")], "script string, pos long, engine string, model string")
    assert chosen(new, manifest, files) == "new"
    assert chosen(new.withColumn("engine", F.lit("other")), manifest, files) == "m"


def test_settings():
    from quire.sources.settings import Settings

    got = Settings.read({"QUIRE_DPI": " 200", "QUIRE_STRICT": "On", "QUIRE_CORS_ORIGINS": "a, ,b", "QUIRE_API_KEYS": "k:t, l : u", "QUIRE_WORKERS": "", "OTHER": "x"})
    assert got == Settings(dpi=200, strict=True, cors_origins=("a", "b"), api_keys=(("k", "t"), ("l", "u")))
    for name, value in (("DPI", "many"), ("STRICT", "maybe"), ("API_KEYS", "lonely")):
        with pytest.raises(ValueError, match=name):
            Settings.read({f"QUIRE_{name}": value})


def test_command_line(spark, tmp_path, capsys):
    from quire.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(png.encode(np.zeros((2, 3), np.uint8)))
    assert main(["run", str(tmp_path / "in"), str(tmp_path / "out")], spark) == 0
    (tmp_path / "in/b.jpg").write_bytes(b"torn")
    assert main(["run", str(tmp_path / "in"), str(tmp_path / "out")], spark) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    spark.createDataFrame([("grc", "abcd", "abce")], "script string, reference string, hypothesis string").write.parquet(str(tmp_path / "pairs"))
    for cer, code in ((0.5, 0), (0.1, 1)):
        spark.createDataFrame([("grc", cer, 1.0)], "script string, cer double, wer double").write.mode("overwrite").parquet(str(tmp_path / "base"))
        assert main(["eval", str(tmp_path / "pairs"), "--baseline", str(tmp_path / "base")], spark) == code
    assert main(["eval", str(tmp_path / "pairs")], spark) == 0 and main(["eval", str(tmp_path / "nowhere")], spark) == 1
    assert main(["what"], spark) == 2 and main([], spark) == 2
    assert main(["doctor", "--models", str(tmp_path)], spark) == 3
    assert "problems" in capsys.readouterr().out


def test_training_run(spark):
    from quire.operators.training import NOTHING, TrainingPorts, run_training

    done = []
    corrections = spark.createDataFrame([("l1", 1, "grc", 20, " text ", "t", True), ("l2", 1, "lat", 20, "x", "t", True), ("l3", 1, "grc", 3, "low", "t", True)], "line_id string, page_no long, script string, h int, corrected_text string, corrected_at string, accepted boolean")
    report = lambda cer: spark.createDataFrame([("grc", cer, 20)], "script string, cer double, samples long")

    def ports(cer, **other):
        base = dict(
            corrections=lambda: corrections, images=lambda: spark.createDataFrame([(1, b"img")], "page_no long, image binary"), export=lambda s: done.append([(r.name, r.text) for r in s.collect()]),
            train=lambda: "new", evaluate=lambda m: report(cer if m else 0.2), register=lambda m, r: done.append(m),
        )
        return TrainingPorts(**(base | other))

    assert run_training(ports(0.1), ["grc"]) == ("promote", "new") and done == [[("line-l1.png", "text")], "new"]
    assert run_training(ports(0.3), ["grc"])[1] is None and done[2:] == [[("line-l1.png", "text")]]
    assert run_training(ports(0.1), ["ell"]) == (NOTHING, None)
    with pytest.raises(ValueError):
        run_training(ports(0.1, evaluate=None), ["grc"])
