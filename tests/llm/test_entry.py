import __spark_entry__

OPS = [f"op{n}_" for n in range(1, 11)]


def test_every_operator_is_registered_once():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(p) for n in names) for p in OPS] == [1] * 10 and "pipeline" in names
