from pathlib import Path

from heddle import storage


class Unset:
    """A session that names no shared folder."""

    def __init__(self, spark):
        self.sparkContext, self.conf = spark.sparkContext, self

    def get(self, key, default):
        return default


def test_shared_folder(spark):
    assert spark.sparkContext.applicationId in storage.shared_dir(spark)
    assert storage.shared_dir(Unset(spark)).startswith(storage.LOCAL_SHARED_DIR)


def test_written_tables_are_in_one_folder_and_cleaned(spark):
    df = storage.written(spark.range(5), "numbers")
    folder = Path(storage.shared_dir(spark).removeprefix("file://"))
    assert df.count() == 5 and list(folder.glob("numbers-*/*.parquet"))
    assert storage.clean(spark) and not folder.exists()
