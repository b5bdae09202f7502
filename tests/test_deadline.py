"""Callables with a time limit, alone and in the plan."""

import os
import time

import pytest
from pyspark import cloudpickle
from test_mime import multi, plain

from mailstruct.config import EngineOptions, Ocr
from mailstruct.functions.deadline import CallFailed, Limited
from mailstruct.plans.engine import Engine


def make_reader():
    """A function that is sent by value: tasks can't import this module."""

    def reader(data):
        if data == b"hang":
            time.sleep(600)
        if data == b"raise":
            raise ValueError("bad image")
        if data == b"die":
            os._exit(3)
        return f"read {data.decode()}"

    return reader


def test_a_call_costs_its_limit_at_most():
    call = Limited(make_reader(), 0.5)
    assert call(b"a") == "read a"
    child = call.child.pid
    assert call(b"b") == "read b" and call.child.pid == child
    began = time.time()
    with pytest.raises(TimeoutError, match=r"0\.5 s"):
        call(b"hang")
    assert time.time() - began < 3
    with pytest.raises(ProcessLookupError):
        os.kill(child, 0)
    assert call(b"c") == "read c"
    with pytest.raises(CallFailed, match="ValueError: bad image"):
        call(b"raise")
    with pytest.raises(CallFailed, match="process died"):
        call(b"die")
    assert call(b"x" * (5 << 20)).startswith("read xxx")
    with pytest.raises(CallFailed, match="lambda|pickle"):
        Limited(lambda _: lambda: 0, 5)(b"")
    assert cloudpickle.loads(cloudpickle.dumps(call)).child is None
    call.stop()


def image(data):
    import base64

    return f'Content-Type: image/png; name="p.png"\nContent-Disposition: inline\nContent-Transfer-Encoding: base64\n\n{base64.b64encode(data).decode()}'


def test_a_hanging_reader_costs_its_limit_and_no_task(spark):
    names = [b"one", b"hang", b"two", b"raise", b"die", b"three"]
    content = multi([plain("body"), *(image(n) for n in names)])
    mails = spark.createDataFrame([(1, content.encode())], "email_id long, content binary")
    engine = Engine(spark, EngineOptions(ocr=Ocr(timeout_seconds=1), ocr_reader=make_reader()))
    began = time.time()
    rows = engine.images(engine.parts(mails).where("error is null")).orderBy("idx").collect()
    assert time.time() - began < 60
    assert [r.ocr_text for r in rows] == ["read one", None, "read two", None, None, "read three"]
    assert [r.ocr_error for r in rows] == [None, "TimeoutError: no answer within 1 s", None, "ValueError: bad image", "ChildProcessError: the process died", None]
