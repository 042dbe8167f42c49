"""Answers' code: cut out natively, tests read from text, each program run (off by default) in an isolated process.

This is no sandbox. It keeps a faulty program from the worker (own process, time and memory limits,
empty environment, temporary folder), not a hostile one from the machine.
"""

from __future__ import annotations

import base64
import contextlib
import io
import json
import os
import pickle
import resource
import signal
import subprocess
import sys
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .once import each_once

#: Runs one answer's tests in its own process: a child of it for each test, with the test's text as its input and a file
#: for its output, and a line of a pipe for each result. What runs a function: the last word before the first
#: bracket names it.
_RUNNER = """
import json, os, resource, signal, sys, time
own = json.load(sys.stdin)
code = own["code"]
def once(test):
    if own["stdin"]:
        exec(compile(code, "answer", "exec"), {"__name__": "__main__"})
        sys.stdout.flush()
        return None
    space = {}
    exec(compile(code, "answer", "exec"), space)
    return space[code.split("(")[0].split()[-1]](*test["args"]) == test["want"]
for number, test in enumerate(own["tests"]):
    with open("in", "w", encoding="utf-8") as f:
        f.write(test.get("input", ""))
    pid = os.fork()
    if not pid:
        resource.setrlimit(resource.RLIMIT_CPU, (own["seconds"] + 1,) * 2)
        os.close(own["results"])
        for name, to, how in (("in", 0, os.O_RDONLY), ("out", 1, os.O_WRONLY | os.O_CREAT | os.O_TRUNC), (os.devnull, 2, os.O_WRONLY)):
            os.dup2(os.open(name, how, 0o600), to)
        sys.stdin, sys.stdout = open(0, encoding="utf-8", closefd=False), open(1, "w", encoding="utf-8", closefd=False)
        try:
            ok = once(test)
        except SystemExit as e:
            sys.stdout.flush()
            ok = None if own["stdin"] and e.code in (None, 0) else False
        except BaseException:
            ok = False
        os._exit(1 if ok is False else 0)
    end, status = time.monotonic() + own["seconds"], None
    while status is None and time.monotonic() < end:
        got, left = os.waitpid(pid, os.WNOHANG)
        if got:
            status = left
        else:
            time.sleep(0.002)
    if status is None:
        os.kill(pid, signal.SIGKILL)
        os.waitpid(pid, 0)
    ok = status == 0
    if ok and own["stdin"]:
        with open("out", encoding="utf-8", errors="replace") as f:
            ok = f.read().strip() == test["want"]
    os.write(own["results"], f"{number} {int(ok)}\\n".encode())
    if not ok:
        break
"""


def fenced_blocks(c: Column) -> Column:
    """The contents of all fenced blocks of a text."""
    return F.regexp_extract_all(c, F.lit(r"(?s)```(?:[a-zA-Z]*)\n(.*?)```"), F.lit(1))


def tidy_code(c: Column) -> Column:
    """Code without the marks that models put around it: up to the first closing mark."""
    t = F.replace(F.substring_index(c, "</code>", 1), F.lit("```python"), F.lit(""))
    return F.replace(F.substring_index(t, "```", 1), F.lit("<code>"), F.lit(""))


def answer_code(text: Column) -> Column:
    """The code of an answer: its last fenced block, tidied; null if it has none."""
    return tidy_code(F.try_element_at(fenced_blocks(text), F.lit(-1)))


def stdin_tests(c: Column) -> Column:
    """Tests written as ``Input: ... Output: ...`` blocks; blocks with none or several outputs go."""
    cut = F.transform(F.split(c, "Input:"), lambda b: F.split(b, "Output:"))
    return F.transform(F.filter(cut, lambda b: F.size(b) == 2), lambda b: F.struct(F.concat(F.trim(F.regexp_replace(b[0], r"^\s+|\s+$", "")), F.lit("\n")).alias("input"), F.concat(F.regexp_replace(b[1], r"^\s+|\s+$", ""), F.lit("\n")).alias("output"), F.lit("stdin").alias("testtype")))


class TestCases:
    """Functional tests in a text, as a table function: (at, input, output, testtype, error).

    A text is a JSON array of tests, or JSON objects one after the other, with or without commas, blanks and lines
    between them, in a fenced block or not. What is no test is a row with an error: where it begins, and why; reading goes on
    at the next line, or the next object on the same line."""

    def eval(self, text: str):
        decoder, text = json.JSONDecoder(), _unfenced(text or "")
        try:
            whole = json.loads(text)
        except json.JSONDecodeError:
            whole = None
        if isinstance(whole, list):
            for i, test in enumerate(whole):
                yield self.row(i, test)
            return
        at, i = 0, 0
        while at < len(text):
            if text[at] in " \t\r\n,":
                at += 1
                continue
            try:
                test, end = decoder.raw_decode(text, at)
                yield self.row(i, test)
            except json.JSONDecodeError as e:
                found = [k for k in (text.find("\n", at + 1), text.find("{", at + 1)) if k >= 0]
                end = min(found, default=len(text))
                yield i, None, None, None, f"at {at}: {e.msg}"
            at, i = end, i + 1

    @staticmethod
    def row(i: int, test: object):
        if not isinstance(test, dict) or "input" not in test or "output" not in test:
            return i, None, None, None, "no input and output"
        said = lambda x: x if isinstance(x, str) else json.dumps(x)
        return i, said(test["input"]), said(test["output"]), "functional", None


def _unfenced(text: str) -> str:
    text = text.strip()
    for mark in ("```json", "```"):
        text = text.removeprefix(mark)
    return text.removesuffix("```").strip()


_TESTS = StructType([StructField("at", IntegerType())] + [StructField(n, StringType()) for n in ("input", "output", "testtype", "error")])


def test_cases(rows: DataFrame, column: str = "text") -> DataFrame:
    """``rows`` joined to the functional tests of a text column; a row without any is gone."""
    return rows.lateralJoin(F.udtf(TestCases, returnType=_TESTS)(F.col(column).outer()))


def _value(text: str):
    """A number, a list, or the text without its quotes."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return json.loads(text) if text.startswith("[") and text.endswith("]") else text.strip('"')


def call_arguments(text: str) -> list:
    """The arguments of a functional test: ``a = 1, b = 2``, or one in each line."""
    if "=" in text:
        named = text.split(",") if "," in text else [text]
        out = []
        for part in named:
            own = part.split("=")
            if len(own) != 2:
                raise ValueError(f"not one name and one value: {part!r}")
            value = own[1].strip()
            try:
                out.append(int(value))
            except ValueError:
                try:
                    out.append(float(value))
                except ValueError:
                    out.append(value.strip('"'))
        return out
    return [_value(line.strip()) for line in text.split("\n") if line.strip()]


def expected(text: str):
    try:
        return json.loads(text.strip())
    except json.JSONDecodeError:
        return text.strip()


def _limits(memory_mb: int):
    def apply() -> None:
        resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20,) * 2)

    return apply


def _wanted(test: dict, is_stdin: bool) -> dict:
    if not is_stdin:
        return {"args": call_arguments(test["input"]), "want": expected(test["output"])}
    want = test["output"].strip()
    return {"input": test["input"], "want": want[: want.rfind("-")].rstrip() if want.endswith("-") else want}


def run_tests(code: str, tests: list[dict], is_stdin: bool, allow: bool = False, seconds: int = 6, memory_mb: int = 512) -> list[bool]:
    """A result for each test (input, output). One isolated process runs them one after the other, each at most
    ``seconds``, and sends each result when it is there; the process itself has ``(seconds + 1) * n + 5`` seconds. What is
    not sent by then has failed, and so have the tests after the first failure."""
    if not allow:
        raise PermissionError("running answers' code is off; pass allow=True to run it")
    wanted = [_wanted(t, is_stdin) for t in tests]
    done = [False] * len(tests)
    read, write = os.pipe()
    with tempfile.TemporaryDirectory() as folder, os.fdopen(read) as results:
        given = json.dumps({"code": code, "tests": wanted, "stdin": is_stdin, "seconds": seconds, "results": write})
        process = subprocess.Popen([sys.executable, "-I", "-c", _RUNNER], stdin=subprocess.PIPE, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, text=True, cwd=folder, env={}, pass_fds=(write,), start_new_session=True, preexec_fn=_limits(memory_mb))
        os.close(write)
        try:
            process.communicate(given, timeout=(seconds + 1) * len(tests) + 5)
        except subprocess.TimeoutExpired:
            pass
        finally:
            with contextlib.suppress(ProcessLookupError):
                os.killpg(process.pid, signal.SIGKILL)  # and whatever the program has started
            process.wait()
        for line in results:
            number, ok = map(int, line.split())
            done[number] = bool(ok)
    return done


def run_stdin_tests(code: str, tests: list[dict], allow: bool = False, seconds: int = 6, memory_mb: int = 512) -> bool:
    """Do all tests (input, output) pass? No tests is a failure."""
    return bool(tests) & all(run_tests(code, tests, True, allow, seconds, memory_mb))


def run_function_tests(code: str, tests: list[dict], allow: bool = False, seconds: int = 6, memory_mb: int = 512) -> bool:
    """As :func:`run_stdin_tests`, for code that is a function: its value must equal the output."""
    try:
        return bool(tests) & all(run_tests(code, tests, False, allow, seconds, memory_mb))
    except (ValueError, TypeError):
        return False


def with_code_scores(rows: DataFrame, text: str = "text", tests: str = "tests", is_stdin: str = "is_stdin", allow: bool = False, seconds: int = 6) -> DataFrame:
    """``rows`` with score and error: 1 if the answer's last code block passes all tests (an array of input and
    output), else 0; the error says why nothing was run. Each different program with its tests
    runs once, for all rows that have it, and programs are dealt over all tasks."""
    if not allow:
        raise PermissionError("running answers' code is off; pass allow=True to run it")
    kind = "array<struct<input:string,output:string>>"
    own = {"code__": answer_code(F.col(text)), "stdin__": F.coalesce(is_stdin, F.lit(False)), "tests__": F.col(tests).cast(kind)}
    held = rows.drop("score", "error").withColumns(own)

    def one(r: dict) -> tuple[float, str | None]:
        if not r["code__"]:
            return 0.0, "no code"
        if not r["tests__"]:
            return 0.0, "no tests"
        try:
            return float(all(run_tests(r["code__"], r["tests__"], r["stdin__"], True, seconds))), None
        except (ValueError, TypeError) as e:
            return 0.0, f"unreadable test: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.string())], [*batch.schema.names, "score", "error"])

    programs = each_once(held.select(*own))
    ran = programs.mapInArrow(run, StructType([*programs.schema.fields, StructField("score", DoubleType()), StructField("error", StringType())]))
    scored = ran.select(*[F.col(c).alias(f"{c}of") for c in own], "score", "error")
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}of"))
    return held.join(scored, same, "left").drop(*own, *[f"{c}of" for c in own])


def code_accuracy(rows: DataFrame, allow: bool = False, seconds: int = 6) -> DataFrame:
    """(id, score) of rows (id, text, is_stdin, tests); an answer without code is 0."""
    return with_code_scores(rows.select("id", "text", "is_stdin", "tests"), allow=allow, seconds=seconds).select("id", "score")


class _TextOnly(pickle.Unpickler):
    """Reads a pickled text and nothing that names a class or a function."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def decode_tests(encoded: str | None) -> str | None:
    """Private tests (a JSON text, pickled, compressed, in base64) as JSON text; null if they aren't that."""
    try:
        text = _TextOnly(io.BytesIO(zlib.decompress(base64.b64decode(encoded or "")))).load()
        json.loads(text)
        return text
    except (ValueError, TypeError, EOFError, zlib.error, pickle.UnpicklingError):
        return None


def with_private_tests(rows: DataFrame, column: str = "private_test_cases") -> DataFrame:
    """``rows`` with the column decoded."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, column, pa.array([decode_tests(x) for x in batch.column(at).to_pylist()], pa.string()))

    return rows.mapInArrow(run, rows.schema)


def code_projection(problems: DataFrame) -> DataFrame:
    """Source problems as the rows that code matching reads."""
    from .prompts import has_test_type

    return problems.select(
        F.col("question_content").alias("prompt"),
        F.col("private_test_cases").alias("test"),
        F.col("starter_code").alias("entry_point"),
        F.lit("").alias("canonical_solution"),
        F.col("question_id").alias("task_id"),
        has_test_type(F.col("public_test_cases"), "stdin").alias("is_stdin"),
        "public_test_cases",
        "difficulty",
        *[c for c in ("global_idx", "_index") if c in problems.columns],
    )
