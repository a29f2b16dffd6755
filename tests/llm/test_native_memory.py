"""Native memory of the driver's JVM."""

import re
from pathlib import Path

import pytest

from strandframe.llm import common


def test_tidy_gives_free_native_memory_back(spark):
    if not common.trim_native(spark):
        pytest.skip("this JVM can't")
    jvm = spark._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    rss = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) / 1024
    some = [jvm.java.util.zip.Deflater() for _ in range(800)]  # each some 260 KB outside the heap
    for x in some[::2]:
        x.end()  # those that stay keep the allocator from giving the holes back by itself
    jvm.System.gc()
    held = rss()
    common.tidy(spark)
    freed = held - rss()
    for x in some[1::2]:
        x.end()
    assert freed > 40
