"""Generated load, and the command line."""

from lithoframe.__main__ import main
from lithoframe.operators import log as G
from lithoframe.plans import generators


def test_chain_load(spark):
    load = generators.chain_load(spark, 3, 4)
    assert load.count() == 3 + 3 * 4 * 3
    state = G.materialize(load)
    assert state.agents.count() == 3 and state.bindings.count() == 36 and state.edges.count() == 24
    assert {len(r.blocks) for r in state.bindings.collect()} == {1, 2, 3}
    assert {(r.n) for r in state.bindings.groupBy("agent").count().withColumnRenamed("count", "n").collect()} == {12}


def test_payload_load(spark):
    rows = generators.payload_load(spark, 5, 100).collect()
    assert {len(r.payload) for r in rows} == {100} and len({bytes(r.payload) for r in rows}) == 5


def test_command_line(spark, tmp_path, capfd):
    file = tmp_path / "f"
    file.write_bytes(b"abc")
    root = str(tmp_path / "root")
    assert main([root, "put", str(file)]) == 0
    assert main([root, "get", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]) == 0
    out = capfd.readouterr().out
    assert "ba7816bf" in out and "abc" in out
    assert main([root, "get", "none"]) == 1 and main([root]) == 2 and main([root, "what"]) == 2
    assert main([root, "key", "1", "2"]) == 0 and main([root, "fsck"]) == 0
    assert '"intact":1' in capfd.readouterr().out
