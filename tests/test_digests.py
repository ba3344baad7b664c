import hashlib
import random

import pytest

from aerostrata.operators import labels


@pytest.mark.parametrize("few", [1, 4096])
def test_the_kth_digest_by_narrowing(spark, monkeypatch, few):
    monkeypatch.setattr(labels, "_FEW", few)
    digests = [hashlib.md5(str(i).encode()).hexdigest() for i in range(500)]
    digests += [digests[7]] * 200 + [digests[7][:-1] + "0", digests[7][:-1] + "f"]
    random.Random(1).shuffle(digests)
    table = spark.createDataFrame([(d,) for d in digests], "_digest string").repartition(3)
    for fraction in (0.0, 0.02, 0.5, 1.0):
        want = sorted(digests)[max(1, int(len(digests) * fraction)) - 1]
        assert [r[0] for r in labels.chosen_digests(table, fraction).collect()] == [want]
    assert labels.chosen_digests(table.filter("false"), 0.1).collect() == []
