"""Documents are made once for all tables and dictionaries of their compact form."""

import json

from pyspark.sql import functions as F

from clipgraph.sources import annotations, compact_docs


def test_documents_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)
    clip = {"objects": [{"obj_id": "cup_01", "category": "cup", "first_seen_frame": 1, "attributes": {"color": "red"}}], "events": [],
            "clip_metadata": {"clip_index": 0, "frame_indices": [0, 20], "status": "annotated"}}
    (tmp_path / "d.json").write_text("\n".join(json.dumps({"video_id": f"v{i}", "num_clips": 1, "clips": [clip]}) for i in range(5)))

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    docs = annotations.scan_annotations(spark, str(tmp_path), multi_line=False)
    docs = docs.mapInArrow(seen, docs.schema)
    texts = [json.loads(r.value) for r in compact_docs.encode(docs).orderBy(F.col("video_id")).collect()]
    assert [t["video_id"] for t in texts] == [f"v{i}" for i in range(5)] and texts[0]["clips"][0]["o"] == [["cup_01", 1, 0]]
    assert made.value == 5
