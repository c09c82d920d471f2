"""Objects by key: whole contents, repeats, missing and null keys."""

import uuid

from tidewell.operators import objects
from tidewell.sources.shared import shared_folder


def test_objects_are_put_copied_deleted_and_listed(spark):
    folder = f"{shared_folder(spark)}/o-{uuid.uuid4().hex}"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    rows = [("a.txt", bytearray(b"one")), ("b.txt", bytearray(b"")), (None, bytearray(b"x")), ("c.txt", None), ("d.txt", bytearray(b"y" * 100_000))]
    assert objects.put_objects(frame(rows, "key string, content binary"), folder) == 3
    assert objects.put_objects(frame(rows[:1], "key string, content binary"), folder) == 1
    listed = lambda: {r.key: r.length for r in objects.list_objects(spark, folder).collect()}
    assert listed() == {"a.txt": 3, "b.txt": 0, "d.txt": 100_000}
    pairs = [("a.txt", "a2.txt"), ("gone.txt", "g.txt"), (None, "n.txt"), ("d.txt", "b.txt")]
    assert objects.copy_objects(frame(pairs, "source string, target string"), folder) == 2
    assert objects.delete_objects(frame([("a.txt",), ("never.txt",), (None,)], "key string"), folder) == 1
    assert objects.delete_objects(frame([("a.txt",)], "key string"), folder) == 0
    assert listed() == {"a2.txt": 3, "b.txt": 100_000, "d.txt": 100_000}
    assert objects.put_objects(frame(rows, "key string, content binary").limit(0), folder) == 0
