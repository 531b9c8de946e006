"""Tables that a job writes for itself in the folder all machines share."""

import tempfile
import uuid


def shared_dir(spark):
    """spark.checkpoint.dir; only a local session may leave it unset and gets its own folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/larder-{uuid.uuid4().hex}/{name}"
