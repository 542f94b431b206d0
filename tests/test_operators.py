import io
import json
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliospark import facade
from foliospark import errors as facade_errors
from foliospark.errors import ApiError
from foliospark.functions import links as L
from foliospark.functions import text as X
from foliospark.operators import archive, batching, enrich, merge, planning, state
from foliospark.sources import files, providers, settings, sinks
from foliospark.streaming.fold import poll


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find this module


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def ranges(spark, n, cap=200):
    rows = planning.page_ranges(spark.createDataFrame([(n,)], "page_count int"), cap).collect()
    return [(r.page_start, r.page_end) for r in rows], [r.page_ranges for r in rows]


@pytest.mark.parametrize("n, spans", [(1, [(1, 1)]), (199, [(1, 199)]), (200, [(1, 200)]), (201, [(1, 200), (201, 201)]), (364, [(1, 200), (201, 364)]), (400, [(1, 200), (201, 400)])])
def test_page_ranges(spark, n, spans):
    got, named = ranges(spark, n)
    assert got == spans
    assert named == ([None] if n <= 200 else [f"{a}-{b}" for a, b in spans])


@pytest.mark.parametrize("n, cap", [(1, 1), (17, 3), (100, 10), (99, 100)])
def test_ranges_cover_all_pages(spark, n, cap):
    got, _ = ranges(spark, n, cap)
    assert [p for a, b in got for p in range(a, b + 1)] == list(range(1, n + 1))
    assert all(b - a < cap for a, b in got)


def test_bisect(spark):
    rows = spark.createDataFrame([("a", 1, 200, [1] * 200), ("b", 1, 1, [99])], "job_id string, page_start int, page_end int, size array<int>")
    got = {(r.job_id, r.page_start, r.page_end): r.oversize for r in planning.bisect(rows, "size", 60).collect()}
    assert got == {("a", 1, 50): False, ("a", 51, 100): False, ("a", 101, 150): False, ("a", 151, 200): False, ("b", 1, 1): True}


def test_routes(spark):
    rows = [("a.pdf", 5, 3, "logical"), ("b.PDF", 50, 3, "physical"), ("c.docx", 5, None, "office"), ("d.docx", 50, None, "rejected"), ("e.txt", 5, None, "rejected"), ("f.pdf", 0, 3, "rejected"), ("g.pdf", 5, 0, "rejected"), ("h.pdf", None, 1, "rejected")]
    got = planning.route(spark.createDataFrame([r[:3] for r in rows], "path string, length long, page_count int"), 10).collect()
    assert [r.route for r in got] == [r[3] for r in rows]
    assert "export it to PDF" in got[3].reason


def test_names(spark):
    assert one(spark, "My File (v2).pdf", X.safe_stem(F.col("x")))[0] == "My-File-v2"
    assert one(spark, "文档.pdf", X.safe_stem(F.col("x")))[0] == "document"
    assert one(spark, "j", X.part_data_id(F.col("x"), F.lit(1), F.lit(1), F.lit(200)))[0] == "j.p0001-0200"
    assert one(spark, "j", X.part_data_id(F.col("x"), F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("int")))[0] == "j.part-0001"
    assert one(spark, "j", X.part_data_id(F.col("x"), F.lit(1), F.lit(12345), F.lit(12346)))[0] == "j.p12345-12346"


def test_batches_of_fifty(spark):
    parts = spark.range(120).select(F.lit("j").alias("job_id"), F.col("id").alias("part_index"))
    n = batching.batches(parts, "job_id", ["part_index"]).groupBy("batch_no").count().orderBy("batch_no").collect()
    assert [r["count"] for r in n] == [50, 50, 20]


def test_request(spark):
    o = facade.default_options()
    parts = spark.createDataFrame([("j", 2, "a.p2.pdf", "a.2", "201-400", 0), ("j", 1, "a.p1.pdf", "a.1", "", 0)], "job_id string, part_index int, upload_name string, data_id string, page_ranges string, batch_no int")
    body = json.loads(batching.requests(parts.withColumn("options", o)).first()["request"])
    assert [f.get("page_ranges") for f in body["files"]] == [None, "201-400"]
    assert body["model_version"] == "vlm" and "extra_formats" not in body


@pytest.mark.parametrize(
    "parts, wanted",
    [
        ([("done", "t"), ("failed", None), ("running", None)], "failed"),
        ([("done", "t"), ("running", None)], "running"),
        ([("done", "t"), ("done", None)], "pending"),
        ([("done", "t"), ("done", "u")], "done"),
        ([(None, None)], "pending"),
    ],
)
def test_fold(spark, parts, wanted):
    for order in (parts, parts[::-1]):
        rows = spark.createDataFrame([("j", *p) for p in order], "job_id string, state string, full_md string")
        assert state.fold_jobs(rows).first()["state"] == wanted


def test_reconcile(spark):
    schema = "batch_id string, data_id string, upload_name string, state string, progress string, full_zip_url string, error_code string, error_message string, trace_id string, full_md string"
    parts = spark.createDataFrame([("b", i, f"n{i}", "waiting-file", None, None, None, None, None, None) for i in ("1", "2", "3", "4")], schema)
    said = [("b", 0, "1", "zz", "running"), ("b", 1, "1", "zz", "done"), ("b", 2, "", "n1", "failed"), ("b", 3, None, "n2", "failed"), ("b", 4, "4", "", None)]
    status = spark.createDataFrame([(*r, None, None, None, None, None) for r in said], "batch_id string, ord long, data_id string, file_name string, state string, extract_progress string, full_zip_url string, err_msg string, err_code string, trace_id string")
    got = {r.data_id: (r.state, r.matched_by) for r in state.reconcile(parts, status).collect()}
    assert got == {"1": ("done", "data_id"), "2": ("failed", "name"), "3": ("waiting-file", None), "4": ("waiting-file", "data_id")}


def test_links_stay(spark):
    for text in ("![a](https://x/y.png)", "[b](#s)", "[c](/abs.png)", "![d](missing.png)", "![e](../i/x.png)", "no links", "", "[f](data:x)"):
        assert one(spark, text, L.rewrite_links(F.col("x"), F.array(F.lit("i/x.png")), F.lit(3)))[0] == text


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("![a](i/x.png?v=1#f)", "![a](assets/part-0003/i/x.png?v=1#f)"),
        ('![a](i/x.png "t") ![m](no.png)', '![a](assets/part-0003/i/x.png "t") ![m](no.png)'),
        ("<img SRC = 'i/x.png'>", "<img SRC = 'assets/part-0003/i/x.png'>"),
        ("[s](./i/y%20z.csv)", "[s](assets/part-0003/i/y z.csv)"),
        ("[p](i/a+b.csv)", "[p](assets/part-0003/i/a+b.csv)"),
    ],
)
def test_links_are_led(spark, text, wanted):
    known = F.array(*[F.lit(a) for a in ("i/x.png", "i/y z.csv", "i/a+b.csv")])
    assert one(spark, text, L.rewrite_links(F.col("x"), known, F.lit(3)))[0] == wanted


def test_merge(spark):
    md = "# Part {0}\n\n![figure](images/same.png)\n"
    parts = spark.createDataFrame([("j", 2, 201, 201, "done", md.format(2)), ("j", 1, 1, 200, "done", md.format(1)), ("k", 1, None, None, "running", None)], "job_id string, part_index int, page_start int, page_end int, state string, full_md string")
    led = parts.withColumn("full_md", L.rewrite_links(F.col("full_md"), F.array(F.lit("images/same.png")), F.col("part_index")))
    got = {r.job_id: r for r in merge.merge_parts(led).collect()}
    assert got["j"].full_md == (
        "<!-- source pages 1-200 -->\n\n# Part 1\n\n![figure](assets/part-0001/images/same.png)\n\n<!-- source pages 201-201 -->\n\n# Part 2\n\n![figure](assets/part-0002/images/same.png)\n"
    )
    assert not got["k"].mergeable and got["k"].full_md is None


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def test_archives(spark):
    made = [("good.zip", zipped({"a/full.md": "text", "a/images/x.png": "x"})), ("bad.zip", zipped({"../escape.txt": "bad", "full.md": "t"})), ("none.zip", zipped({"x": "x"})), ("broken.zip", b"no zip")]
    rows = spark.createDataFrame(made, "path string, content binary")
    got = {r.archive: r for r in facade.extracted(rows).collect()}
    assert set(got) == {"good.zip", "none.zip"}
    assert got["good.zip"].full_md == "text" and got["none.zip"].error
    members = archive.read_members(rows).where("error is null")
    with pytest.raises(Exception, match="unsafe member"):
        archive.safe_members(members, strict=True).collect()


@pytest.mark.parametrize("name, attr, safe", [("/etc/x", 0, False), ("a/../b", 0, False), ("..\\x", 0, False), ("a", 0o120777 << 16, False), ("a/b..c", 0o100644 << 16, True)])
def test_member_safety(spark, name, attr, safe):
    assert one(spark, name, archive.member_is_safe(F.col("x"), F.lit(attr).cast("long")))[0] is safe


@pytest.mark.parametrize("text, k", [('```json\n{"a":1}\n```', 1), ('Sure: {"a":1} done', 1), ('{"a":1} and {"b":2}', None), ('{"a":1}', 1), ("", None), ("NaN", None), ('{"a":1}], [{"a":2}', None)])
def test_tolerant_json(spark, text, k):
    assert one(spark, text, F.try_variant_get(X.tolerant_json(F.col("x")), "$.a", "int"))[0] == k


def test_text_functions(spark):
    assert one(spark, "a|b\nc", X.escape_pipe(F.col("x")))[0] == "a\\|b c"
    assert one(spark, "", X.render_tags(F.array(F.lit("#x"), F.lit(" y "), F.lit(""), F.lit("##"))))[0] == "`#x` `#y` `#`"
    assert one(spark, "x" * 81, X.truncated(F.col("x"), 80))[0] == "x" * 80 + "\n\n[…truncated…]"
    assert one(spark, "　x\n", X.strip(F.col("x")))[0] == "x"
    assert one(spark, "q", X.data_url(F.lit("a.GIF"), F.lit(b"x" * 100)))[0].count("\n") == 0
    for reply, text in (({"choices": [{"message": {"content": "hi"}}]}, "hi"), ({"choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}]}}]}, "ab"), ({"choices": []}, None)):
        assert one(spark, json.dumps(reply), X.chat_content(F.col("x")))[0] == text


def test_enhance_isolates_errors(spark):
    docs = spark.createDataFrame([("a", "text a"), ("b", None)], "job_id string, full_md string")
    images = spark.createDataFrame([("a", "x.png", b"1"), ("a", "y.gif", b"2")], "job_id string, file string, content binary")

    class Provider(providers.StubEnrichment):
        def analyze_image(self, url):
            if "gif" in url:
                raise ValueError("no gif")
            return super().analyze_image(url)

    got = {r.job_id: r for r in facade.enhance(docs, images, Provider(), "{markdown}").collect()}
    assert got["a"].enhanced_md.startswith("text a\n\n---\n\n> ## Document metadata") and "no gif" in got["a"].enhanced_md
    assert got["b"].enhanced_md is None and got["b"].enhance_error == "no text"
    assert enrich.HEADINGS["images"] in got["a"].enhanced_md


def test_retries_and_answers():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ApiError("busy", code="-60009")
        return "ok"

    assert providers.with_retries(flaky, "code", providers.is_transient, waits.append, lambda: 0)() == "ok"
    assert waits == [1, 2]
    with pytest.raises(ApiError, match="export Office"):
        providers.checked({"code": -60005, "msg": "no"})
    with pytest.raises(ApiError):
        providers.require_https("http://x")
    assert providers.retryable_status(429) and not providers.retryable_status(404)


def test_poll():
    time = iter(range(100))
    assert poll(lambda: "running", 5, 0, lambda: next(time), lambda s: None) == ("running", True)
    assert poll(lambda: "failed", 5, 0, lambda: 0, lambda s: None) == ("failed", False)


def test_settings(tmp_path, monkeypatch):
    path = tmp_path / "c.toml"
    monkeypatch.delenv(settings.ENVIRONMENT, raising=False)
    settings.save_token('owner-"token"', path)
    assert settings.token(path) == ('owner-"token"', "config")
    monkeypatch.setenv(settings.ENVIRONMENT, "env")
    assert settings.token(path) == ("env", "environment") and "token" not in json.dumps(settings.status(path)).replace("foliospark_token", "").replace("FOLIOSPARK_TOKEN", "")
    assert settings.clear_token(path) and not settings.clear_token(path)


def pdf(pages):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj << /Type /Page >> endobj\n" % i for i in range(pages)) + b"<< /Type /Pages >>"


def test_engine(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a b.pdf").write_bytes(pdf(201))
    (source / "c.docx").write_bytes(b"word")
    (source / "d.txt").write_bytes(b"no")
    engine = facade.Engine(spark, str(tmp_path / "state"), providers.StubExtraction())
    assert {r.state for r in engine.submit(str(source)).collect()} == {"pending"}
    assert engine.parts().count() == 3
    parts = engine.public()
    assert "full_zip_url" not in parts.columns
    assert {r.state for r in engine.status().collect()} <= {"done", "pending"}
    job = next(r.job_id for r in engine.parts().collect() if r.page_start is None)
    assert engine.wait(job, 1, 0)["state"] == "done"
    engine.clean(job)
    assert job not in {r.job_id for r in engine.parts().collect()}
    with pytest.raises(ValueError):
        engine.clean("../x")


def test_bundles_are_swapped(spark, tmp_path):
    out = str(tmp_path / "bundle")
    for text in ("first", "second"):
        sinks.write_bundles(spark.createDataFrame([("j", text)], "job_id string, full_md string"), out)
    assert spark.read.parquet(f"{out}/full_md").first()["full_md"] == "second"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bundle"]


def test_status_source(spark):
    spark.dataSource.register(providers.StatusSource)
    got = spark.read.format("batch_status").option("batches", "b-x,b-y").load().collect()
    assert {r.data_id for r in got} == {"x", "y"}


def test_page_counts(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(3))
    (tmp_path / "b.pdf").write_bytes(b"junk")
    got = {r.path.rpartition("/")[2]: r for r in files.page_counts(files.sources(spark, str(tmp_path), content=True)).collect()}
    assert got["a.pdf"].page_count == 3 and got["b.pdf"].page_count is None and got["b.pdf"].error


class Service(providers.StubExtraction):
    """Serves real archives, by what a part is called; counts nothing, so that it may run anywhere."""

    def batch_status(self, batch_id):
        rows = [{"data_id": d, "state": "failed" if d.endswith("0201-0400") else "done", "err_msg": "bad page", "err_code": "7", "full_zip_url": f"https://results/{d}"} for d in batch_id[2:].split("+")]
        return {"code": 0, "trace_id": "t", "data": {"extract_result": rows}}

    def request_uploads(self, request):
        names = [f["data_id"] for f in json.loads(request)["files"]]
        return {"code": 0, "trace_id": "t", "data": {"batch_id": f"b-{'+'.join(names)}", "file_urls": [f"https://upload/{n}" for n in names]}}

    def upload(self, url, content):
        if b"refuse" in content:
            return 403
        return 204

    def download(self, url):
        made = {"out/full.md": f"# {url[-4:]}\n\n![f](images/same.png) [x](images/none.png)\n", "out/images/same.png": f"image {url[-4:]}", "out/images/unused.png": "u", "other.json": "{}"}
        return zipped(made)


def jobs_of(engine):
    return {r.source_name: r for r in engine.jobs().collect()}


def test_engine_brings_results_home(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pdf").write_bytes(pdf(3))
    (source / "b.docx").write_bytes(b"word")
    (source / "c.docx").write_bytes(b"refuse")
    (source / "d.txt").write_bytes(b"no")
    (source / "e.pdf").write_bytes(pdf(450))
    engine = facade.Engine(spark, str(tmp_path / "state"), providers.Patient(Service(), lambda s: None))
    rows = {r["source_name"]: r for r in engine.process(str(source), timeout=0, enrichment=providers.StubEnrichment())}
    assert {n: r["state"] for n, r in rows.items()} == {"a.pdf": "done", "b.docx": "done", "c.docx": "failed", "d.txt": "failed", "e.pdf": "failed"}
    assert "403" in rows["c.docx"]["error_message"] and rows["d.txt"]["error_message"] == "unsupported" and rows["e.pdf"]["error_message"] == "bad page"
    home = source / "a.pdf.parts"
    text = (home / "full.md").read_text()
    assert text == "<!-- source pages 1-3 -->\n\n# 0003\n\n![f](assets/part-0001/images/same.png) [x](images/none.png)\n"
    assert (home / "assets/part-0001/images/same.png").read_text() == "image 0003"
    assert not (home / "assets/part-0001/images/unused.png").exists()
    shown = json.loads((home / "manifest.json").read_text())
    assert shown["source_name"] == "a.pdf" and shown["parts"][0]["page_end"] == 3 and "full_zip_url" not in (home / "manifest.json").read_text()
    assert rows["a.pdf"]["enhanced"] and "> ## Document metadata" in (home / "full.enhanced.md").read_text()
    assert "assets/part-0001/images/same.png" in (home / "full.enhanced.md").read_text()
    assert set(jobs_of(engine)) == {"c.docx", "d.txt", "e.pdf"}  # what is done is exported and removed
    assert not [p for p in (tmp_path / "state/assets").iterdir() if rows["a.pdf"]["job_id"] in p.name]
    late = rows["e.pdf"]["job_id"]
    parts = {r.part_index: r for r in engine.parts().where(F.col("job_id") == late).collect()}
    assert {i: r.state for i, r in parts.items()} == {1: "done", 2: "failed", 3: "done"} and parts[2].error_code == "7" and parts[1].full_md
    again = facade.Engine(spark, str(tmp_path / "state"), providers.Patient(providers.StubExtraction("running"), lambda s: None))
    assert again.resume(late).first()["state"] == "pending"
    assert {r.part_index: r.state for r in again.parts().where(F.col("job_id") == late).collect()} == {1: "done", 2: "waiting-file", 3: "done"}
    with pytest.raises(facade.FolioError):
        engine.status("nojob")


class Broken(Service):
    def download(self, url):
        return {"docx": b"no archive", "0001": zipped({"../escape.txt": "bad", "full.md": "t"}), "0002": zipped({"x.md": "t"})}.get(url[-4:], b"no archive")


def test_engine_refuses_bad_archives(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n in (1, 2):
        (source / f"{n}.pdf").write_bytes(pdf(n))
    (source / "x.docx").write_bytes(b"word")
    engine = facade.Engine(spark, str(tmp_path / "state"), providers.Patient(Broken(), lambda s: None))
    engine.submit(str(source))
    assert {r.state for r in engine.status().collect()} == {"pending"}
    errors = {r.source_name: r.error_message for r in engine.jobs().collect()}
    assert "unsafe" in errors["1.pdf"] and "expected one full.md" in errors["2.pdf"] and errors["x.docx"]
    assert engine.merged().count() == 0


class Letters:
    """A file of letters, each a page."""

    def count(self, content):
        return len(content)

    def cut(self, content, start, end):
        if b"x" in content:
            raise ValueError("can't be cut")
        return content[start - 1 : end] * 3


def test_engine_splits_large_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pdf").write_bytes(b"abcdefghij")
    (source / "b.pdf").write_bytes(b"xxxxxxxxxx")
    engine = facade.Engine(spark, str(tmp_path / "state"), providers.Patient(Service(), lambda s: None), max_bytes=5, target_bytes=9, splitter=Letters())
    engine.submit(str(source))
    parts = sorted((r.part_index, r.page_start, r.page_end, r.physical, r.state, r.page_ranges) for r in engine.parts().collect())
    assert parts == [(1, 1, 3, True, "waiting-file", None), (2, 4, 5, True, "waiting-file", None), (3, 6, 8, True, "waiting-file", None), (4, 9, 10, True, "waiting-file", None)]
    assert [r.reason for r in engine.rejected().collect()] == ["can't be cut"]
    with pytest.raises(facade.FolioError):
        files.PdfSplitter().cut(b"%PDF", 1, 1)


def test_patient_providers():
    waits, said = [], iter([OSError("net"), {"code": -60009}, {"code": 0, "data": 1}])

    class Flaky(providers.StubExtraction):
        def batch_status(self, batch_id):
            x = next(said)
            if isinstance(x, Exception):
                raise x
            return x

        def upload(self, url, content):
            waits.append("put")
            raise OSError("net")

        def download(self, url):
            raise facade_errors.HttpError(429, "slow down", "7")

    p = providers.Patient(Flaky(), waits.append, lambda: 0)
    assert p.batch_status("b")["data"] == 1 and waits == [1, 1]
    with pytest.raises(OSError):
        p.upload("https://x", b"")
    assert waits[2:] == ["put", 1, "put", 2, "put", 4, "put"]
    with pytest.raises(facade_errors.HttpError):
        p.download("https://x")
    assert waits[9:] == [7.0] * 4
    with pytest.raises(ApiError):
        p.download("http://x")


def test_transports():
    seen = []

    def send(method, url, headers, body, timeout):
        seen.append((method, url, headers.get("Authorization"), body))
        if "chat" in url:
            return json.dumps({"choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}]}}]}).encode()
        return 200 if method == "PUT" else b'{"code": 0}'

    p = providers.HttpExtraction("https://api/v1/", "secret", send=send)
    assert p.batch_status("b")["code"] == 0 and p.request_uploads("{}")["code"] == 0 and p.upload("https://s", b"x") == 200
    assert [s[:3] for s in seen] == [("GET", "https://api/v1/extract-results/batch/b", "Bearer secret"), ("POST", "https://api/v1/file-urls/batch", "Bearer secret"), ("PUT", "https://s", None)]
    assert "secret" not in repr(p)
    chat = providers.HttpEnrichment("https://chat/", "key", "m", "what is it?", send=send)
    assert chat.analyze_image("data:x") == "ab"
    asked = json.loads(seen[-1][3])
    assert asked["model"] == "m" and asked["messages"][0]["content"][0]["text"] == "what is it?" and asked["temperature"] == 0.2
    with pytest.raises(ApiError):
        providers.HttpExtraction("https://x", "t", send=lambda *a: b"<html>").batch_status("b")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("FOLIOSPARK_CONFIG", str(tmp_path / "c.toml"))
    monkeypatch.delenv(settings.ENVIRONMENT, raising=False)
    (tmp_path / "a.pdf").write_bytes(pdf(2))
    args = facade._parser().parse_args(["submit", "--root", "r", "x"])
    assert not args.no_ocr and facade.DEFAULTS["is_ocr"] and args.model == "vlm"
    assert facade.main(["submit", "--root", str(tmp_path / "s"), "--provider", "stub", str(tmp_path / "a.pdf")]) == 0
    (job,) = json.loads(capsys.readouterr().out)
    assert job["state"] == "pending" and job["options"]["is_ocr"]
    for bad in (["status", "--root", str(tmp_path / "s"), "--no-refresh", "nojob"], ["clean", "--root", str(tmp_path / "s"), "../x"], ["submit", "--root", "r", "--provider", "https://x", "f"]):
        assert facade.main(bad) == 1
        assert set(json.loads(capsys.readouterr().err)) == {"error", "code"}
    monkeypatch.setattr("sys.stdin", io.StringIO("tok\n"))
    assert facade.main(["config", "set-token"]) == 0 and facade.main(["config", "show"]) == 0
    shown = capsys.readouterr().out
    assert '"effective_source": "config"' in shown and "tok\n" not in shown
    assert facade.main(["config", "clear-token"]) == 0


def test_pages_in_object_streams(spark):
    import zlib

    body = zlib.compress(b"<< /Type /Page >> << /Type /Page >> << /Type /Pages >>")
    made = b"%PDF-1.5\n1 0 obj << /Type /ObjStm /Filter /FlateDecode >> stream\n" + body + b"\nendstream endobj"
    assert files.count_pages(made) == 2
    with pytest.raises(facade.FolioError):
        files.count_pages(b"%PDF-1.5 nothing")


def test_large_archives_stay_packed(spark):
    rows = spark.createDataFrame([("a", zipped({"full.md": "x" * 1000}))], "path string, content binary")
    assert [r.error for r in archive.unpacked(rows, limit=999).collect()] == ["too large unpacked"]
    assert archive.unpacked(rows).first().content == b"x" * 1000


def test_blank_texts_are_not_sent(spark):
    docs = spark.createDataFrame([("a", " \n ")], "job_id string, full_md string")
    images = spark.createDataFrame([], "job_id string, file string, content binary")

    class Strict(providers.StubEnrichment):
        def analyze_text(self, prompt):
            raise ValueError("sent")

    assert "sent" not in (facade.enhance(docs, images, Strict()).first().enhance_error or "")
