"""Services out of process, behind two protocols, and stubs that work without a network.

Calls run in mapInPandas on executors; a call that fails is a row with an error, never a failed task.
"""

from __future__ import annotations

import io
import json
import random
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ApiError, EnrichError, HttpError

#: Answer codes that are worth another try, and those that ask for another file format.
TRANSIENT_CODES = frozenset([-10001, -60001, -60007, -60008, -60009, -60010, -60020, -60021, -60022])
EXPORT_CODES = frozenset([-60005, -60006])
#: Attempts and longest waits in seconds by kind of call.
ATTEMPTS = {"http": (5, 15), "code": (4, 10), "upload": (4, 8), "chat": (4, 8)}
UPLOADED = frozenset([200, 201, 204])
TOO_MANY, SERVER_ERRORS = 429, 500
SCHEME = "https://"


class ExtractionProvider(Protocol):
    def request_uploads(self, request: str) -> dict: ...

    def upload(self, url: str, content: bytes) -> int: ...

    def batch_status(self, batch_id: str) -> dict: ...

    def download(self, url: str) -> bytes: ...


class EnrichmentProvider(Protocol):
    def analyze_text(self, prompt: str) -> str: ...

    def analyze_image(self, data_url: str) -> str: ...


def retryable_status(status):
    """For an int, and for a column of them."""
    return (status == TOO_MANY) | (status >= SERVER_ERRORS)


def retryable(status: Column) -> Column:
    return retryable_status(status)


def transient(code: Column) -> Column:
    """Whether an error code (text) is worth another try."""
    return code.isin(*map(str, TRANSIENT_CODES))


def https(url: Column) -> Column:
    return F.lower(url).startswith(SCHEME)


def checked(body: dict) -> dict:
    """The answer, if its code is 0."""
    code = body.get("code")
    if code != 0:
        hint = "; export Office files to PDF before another try" if code in EXPORT_CODES else ""
        raise ApiError((body.get("msg") or "the provider refused the call") + hint, code=str(code), trace_id=body.get("trace_id"))
    return body


def with_retries(call: Callable, kind: str, retry: Callable[[Exception], bool], sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> Callable:
    """call, tried again while retry says so; waits double up to a longest one, with a quarter second of jitter."""
    attempts, cap = ATTEMPTS[kind]

    def run(*args, **kwargs):
        for k in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception as error:
                if k == attempts - 1 or not retry(error):
                    raise
                after = getattr(error, "retry_after", None)
                sleep(float(after) if after and str(after).isdigit() else min(2**k, cap) + 0.25 * jitter())

    return run


def is_transient(error: Exception) -> bool:
    return isinstance(error, ApiError) and str(error.code).lstrip("-").isdigit() and int(error.code) in TRANSIENT_CODES


def is_passing(error: Exception) -> bool:
    """Whether the network failed, or the server said that it is worth another try."""
    return retryable_status(error.status) if isinstance(error, HttpError) else isinstance(error, OSError)


def require_https(url: str) -> str:
    if not is_https(url):
        raise ApiError("results are only fetched by https")
    return url


def is_https(url: str) -> bool:
    return url.lower().startswith(SCHEME)


class Patient:
    """An extraction provider whose calls are checked, and tried again where that is worth it."""

    def __init__(self, provider: ExtractionProvider, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random):
        self.provider, self.sleep, self.jitter = provider, sleep, jitter

    def _again(self, call: Callable, kind: str, retry: Callable[[Exception], bool]) -> Callable:
        return with_retries(call, kind, retry, self.sleep, self.jitter)

    def _asked(self, call: Callable) -> Callable:
        web = self._again(call, "http", is_passing)
        return self._again(lambda x: checked(web(x)), "code", is_transient)

    def request_uploads(self, request: str) -> dict:
        return self._asked(self.provider.request_uploads)(request)

    def batch_status(self, batch_id: str) -> dict:
        return self._asked(self.provider.batch_status)(batch_id)

    def upload(self, url: str, content: bytes) -> int:
        def once() -> int:
            status = self.provider.upload(url, content)
            if status not in UPLOADED:
                raise HttpError(status, "the upload was refused")
            return status

        return self._again(once, "upload", lambda error: isinstance(error, OSError))()

    def download(self, url: str) -> bytes:
        return self._again(self.provider.download, "http", is_passing)(require_https(url))


class PatientEnrichment:
    """An enrichment provider whose calls are tried again where that is worth it."""

    def __init__(self, provider: EnrichmentProvider, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random):
        self.provider, self.sleep, self.jitter = provider, sleep, jitter

    def analyze_text(self, prompt: str) -> str:
        return with_retries(self.provider.analyze_text, "chat", is_passing, self.sleep, self.jitter)(prompt)

    def analyze_image(self, data_url: str) -> str:
        return with_retries(self.provider.analyze_image, "chat", is_passing, self.sleep, self.jitter)(data_url)


# ---------------------------------------------------------------- transports


def send(method: str, url: str, headers: dict[str, str], body: bytes | None, timeout: float) -> bytes | int:
    """The body of the answer, or for a PUT its status; a refusal is an HttpError, a failing network an OSError."""
    asked = urllib.request.Request(url, data=body, method=method, headers=headers)
    try:
        with urllib.request.urlopen(asked, timeout=timeout) as answer:
            return answer.status if method == "PUT" else answer.read()
    except urllib.error.HTTPError as error:
        raise HttpError(error.code, str(error.reason), error.headers.get("Retry-After")) from error


def _parsed(body: bytes) -> dict:
    try:
        return json.loads(body)
    except ValueError as error:
        raise ApiError("the answer is no JSON") from error


@dataclass
class HttpExtraction:
    """An extraction service at a base address. The timeouts in seconds are for calls and for files."""

    base: str
    token: str = field(repr=False)
    timeout: float = 60
    file_timeout: float = 120
    send: Callable = send

    def _call(self, method: str, path: str, body: bytes | None = None) -> dict:
        headers = {"Authorization": f"Bearer {self.token}", "Accept": "application/json", "Content-Type": "application/json"}
        return _parsed(self.send(method, f"{self.base.rstrip('/')}/{path}", headers, body, self.timeout))

    def request_uploads(self, request: str) -> dict:
        return self._call("POST", "file-urls/batch", request.encode())

    def batch_status(self, batch_id: str) -> dict:
        return self._call("GET", f"extract-results/batch/{batch_id}")

    def upload(self, url: str, content: bytes) -> int:
        return self.send("PUT", url, {}, content, self.file_timeout)

    def download(self, url: str) -> bytes:
        return self.send("GET", require_https(url), {}, None, self.file_timeout)


@dataclass
class HttpEnrichment:
    """A chat service at a base address."""

    base: str
    key: str = field(repr=False)
    model: str
    image_prompt: str
    timeout: float = 120
    send: Callable = send

    def _chat(self, content) -> str:
        headers = {"Authorization": f"Bearer {self.key}", "Accept": "application/json", "Content-Type": "application/json"}
        body = {"model": self.model, "messages": [{"role": "user", "content": content}], "temperature": 0.2}
        reply = _parsed(self.send("POST", f"{self.base.rstrip('/')}/chat/completions", headers, json.dumps(body).encode(), self.timeout))
        try:
            said = reply["choices"][0]["message"].get("content")
        except (KeyError, IndexError, TypeError, AttributeError) as error:
            raise EnrichError("the reply has no choices") from error
        if isinstance(said, list):
            said = "".join(x.get("text", "") for x in said if isinstance(x, dict))
        if not isinstance(said, str):
            raise EnrichError("the reply has no text")
        return said

    def analyze_text(self, prompt: str) -> str:
        return self._chat(prompt)

    def analyze_image(self, data_url: str) -> str:
        return self._chat([{"type": "text", "text": self.image_prompt}, {"type": "image_url", "image_url": {"url": data_url}}])


# ---------------------------------------------------------------- stubs


@dataclass
class StubExtraction:
    """Answers of the right shape, made up from what is asked."""

    state: str = "done"

    def request_uploads(self, request: str) -> dict:
        files = json.loads(request)["files"]
        batch = f"b-{files[0]['data_id']}"
        return {"code": 0, "trace_id": f"t-{batch}", "data": {"batch_id": batch, "file_urls": [f"https://upload/{f['data_id']}" for f in files]}}

    def upload(self, url: str, content: bytes) -> int:
        return 200

    def batch_status(self, batch_id: str) -> dict:
        row = {"data_id": batch_id[2:], "file_name": batch_id, "state": self.state, "full_zip_url": f"https://results/{batch_id}"}
        return {"code": 0, "trace_id": f"t-{batch_id}", "data": {"extract_result": [row]}}

    def download(self, url: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("full.md", require_https(url))
        return out.getvalue()


@dataclass
class StubEnrichment:
    """Counts words; refuses images whose address has the word bad in it."""

    def analyze_text(self, prompt: str) -> str:
        return json.dumps({"sections": [{"title": "all", "summary": f"{len(prompt.split())} words"}], "entities": [], "cross_references": [], "tags": ["stub"]})

    def analyze_image(self, data_url: str) -> str:
        if "bad" in data_url:
            raise EnrichError("unreadable image")
        return json.dumps({"type": "other", "summary": f"{len(data_url)} characters", "elements": [], "key_findings": [], "keywords": []})


def called(rows: DataFrame, column: str | list[str], call: Callable, result: str = "answer", kind: str = "string", errors: tuple[str, str] = ("error_code", "error_message")) -> DataFrame:
    """rows with the call's answer for one or more columns (dicts as JSON; kind is string or binary) and its error; each row on its own."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{result} {kind}", *(f"{e} string" for e in errors)])
    columns = [column] if isinstance(column, str) else column

    def one(values) -> tuple:
        try:
            answer = call(*values)
            return (answer if kind == "binary" or isinstance(answer, str) else json.dumps(answer)), None, None
        except Exception as error:  # noqa: BLE001  a failed call is a row with an error
            return None, str(getattr(error, "code", None) or type(error).__name__), str(error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(values) for values in zip(*(batch[c] for c in columns))]
            yield batch.assign(**{n: [f[i] for f in found] for i, n in enumerate((result, *errors))})

    return rows.mapInPandas(run, schema)


STATUS = "struct<code:int,trace_id:string,data:struct<extract_result:array<struct<data_id:string,file_name:string,state:string,extract_progress:string,full_zip_url:string,err_msg:string,err_code:string>>>>"


def status_rows(batches: DataFrame, provider: ExtractionProvider) -> DataFrame:
    """Rows of state.reconcile's status: one call for each distinct batch_id, not one for each part."""
    answers = called(batches.select("batch_id").where("batch_id is not null").distinct(), "batch_id", lambda b: checked(provider.batch_status(b)))
    body = answers.select("batch_id", F.from_json("answer", STATUS).alias("a"))
    rows = body.select("batch_id", "a.trace_id", F.posexplode("a.data.extract_result").alias("ord", "r"))
    return rows.select("batch_id", F.col("ord").cast("long").alias("ord"), "r.*", "trace_id")


class StatusSource(DataSource):
    """spark.read.format("batch_status").option("batches", "a,b"): each batch is a partition that asks the provider itself."""

    provider: ExtractionProvider = StubExtraction()

    @classmethod
    def name(cls) -> str:
        return "batch_status"

    def schema(self) -> str:
        return "batch_id string, ord long, data_id string, file_name string, state string, full_zip_url string"

    def reader(self, schema) -> DataSourceReader:
        return _StatusReader(self.options.get("batches", ""), self.provider)


class _StatusReader(DataSourceReader):
    def __init__(self, batches: str, provider: ExtractionProvider):
        self.batches, self.provider = [b for b in batches.split(",") if b], provider

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(b) for b in self.batches]

    def read(self, partition: InputPartition):
        for k, r in enumerate(checked(self.provider.batch_status(partition.value))["data"]["extract_result"]):
            yield partition.value, k, r.get("data_id"), r.get("file_name"), r.get("state"), r.get("full_zip_url")
