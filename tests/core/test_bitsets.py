"""Sets of words against Python sets."""

import random

from meetflow.operators import bitsets


def test_bitsets(spark):
    """Negative, large and null ids, repeated rows, a null key, keys that only one side has."""
    rng = random.Random(5)
    pool = [*range(-130, 130), 2**40, 2**62, -(2**62), None]
    rows = [[(rng.choice(["p", "q", None, side]), rng.choice(pool), rng.randrange(3)) for _ in range(400)] for side in "ab"]
    sets = [{k: {e for key, e, _ in r if key == k and e is not None} for k in {key for key, _, _ in r}} for r in rows]
    a, b = (bitsets.pack(spark.createDataFrame(r, "s string, e long, part int").repartition(3), ["s"], "e") for r in rows)

    def read(words):
        out = {}
        for k, e in map(tuple, bitsets.unpack(words, ["s"], "e").collect()):
            assert e not in out.setdefault(k, set())
            out[k].add(e)
        return out

    some = lambda d: {k: v for k, v in d.items() if v}
    keys = set(sets[0]) | set(sets[1])
    x, y = ({k: s.get(k, set()) for k in keys} for s in sets)
    assert read(a) == some(x) and read(bitsets.union(a, b, ["s"])) == some({k: x[k] | y[k] for k in keys})
    assert read(bitsets.intersection(a, b, ["s"])) == some({k: x[k] & y[k] for k in keys})
    assert read(bitsets.difference(a, b, ["s"])) == some({k: x[k] - y[k] for k in keys})
    assert dict(map(tuple, bitsets.lengths(a, ["s"]).collect())) == {k: len(v) for k, v in x.items() if v}
    assert {r[0] for r in bitsets.not_within(a, b, ["s"]).collect()} == {k for k in keys if not x[k] <= y[k]}
    assert bitsets.not_within(bitsets.intersection(a, b, ["s"]), b, ["s"]).count() == 0
    parts = bitsets.pack(spark.createDataFrame(rows[0], "s string, e long, part int"), ["s", "part"], "e")
    assert read(bitsets.meet_all(parts, ["s"])) == some(x)
    none = a.where("false")
    assert bitsets.intersection(none, b, ["s"]).count() == bitsets.difference(none, b, ["s"]).count() == 0
    assert read(bitsets.union(none, a, ["s"])) == some(x)
