import json

import pytest
from conftest import rows

from harrier.operators import markov
from harrier.sources import vendors


def lines(spark, *objects):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in objects], "line string")


def got(df):
    return rows(df.select("machine_id", "pid", "name", "path", "args"))


def test_ways_to_compose(spark):
    full = {"cmdline": "/bin/a -x", "path": "/opt/b", "args": "-y", "pid": 3}
    assert got(vendors.process_rows(lines(spark, full), "command", "m")) == [("m", 3, "a", "/opt/b", "-y")]
    assert got(vendors.process_rows(lines(spark, full), "osquery", "m")) == [("m", 3, "b", "/opt/b", "-y")]
    only = {"cmdline": "/bin/a -x", "hostname": "h"}
    assert got(vendors.process_rows(lines(spark, only), "osquery")) == [("h", 0, "a", "/bin/a", "-x")]
    assert got(vendors.process_rows(lines(spark, only, {"args": "z"}), compose="name_then_args")) == [("h", 0, "a", "", "-x")]
    assert got(vendors.process_rows(lines(spark, {"command": "[kworker/0:1]"}, {"pid": 9}, "{broken", "[1]"))) == [("", 0, "[kworker/0:1]", "", "")]
    assert got(vendors.process_rows(lines(spark, {"Image": "C/x.exe", "ProcessId": "12"}), "Windows")) == [("", 12, "C/x.exe", "C/x.exe", "")]
    assert got(vendors.process_rows(lines(spark, {"binary": "/q"}), aliases={"path": ["binary"]})) == [("", 0, "q", "/q", "")]
    with pytest.raises(ValueError):
        vendors.process_rows(lines(spark, full), compose="otherwise")


def test_files(spark):
    df = lines(spark, {"file_path": " /a ", "date": "d", "mode": "0644", "size": "7", "host": "h"}, {"size": 3}, {"TargetFilename": "/b", "size": "x"})
    assert rows(vendors.file_rows(df, "command", "m").select("machine_id", "path", "mtime", "permissions", "size")) == [("h", "/a", "d", "0644", 7), ("m", "/b", None, None, None)]


def test_a_walk(spark):
    model = markov.train(markov.char_grams(spark.createDataFrame([("abc" * 30,)], "line string"), "line", 2, True, True))
    walk = markov.simulate(model, 2, 50, seed=1)
    assert walk == markov.simulate(model, 2, 50, seed=1) and walk[:6] == "abcabc"
    with pytest.raises(ValueError):
        markov.simulate(model, 2, 5, most=1)
