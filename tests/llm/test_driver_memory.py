import re
from pathlib import Path

from docloom.llm import common


def test_freed_memory_of_the_jvm_goes_back(spark):
    """A written step leaves none of the C library's freed memory with the driver's JVM, which would keep it over all later steps."""
    jvm = spark._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")

    def held() -> float:
        return int(re.search(r"VmRSS:\s+(\d+)", status.read_text())[1]) / 1024

    common.discard(common.materialise(spark.range(10), "first"))
    # each takes some 100 KB or more of the C library; the last stays, so that the library can't shrink what lies before it by itself
    taken = [jvm.java.util.zip.Deflater() for _ in range(1500)]
    for x in taken[:-1]:
        x.end()
    before = held()
    common.discard(common.materialise(spark.range(10), "second"))
    taken[-1].end()
    assert held() < before - 60
