"""Where intermediate data goes, and readers' options."""

import pytest
from kinlink.operators.extract import page_id, visible_text
from kinlink.session import cut, remove_scratch, shared_dir
from kinlink.sources.readers import read_prospects
from pyspark.sql import functions as F


class NoCheckpoint:
    """A Java context without checkpoint folder."""

    def __init__(self, context):
        self.hadoopConfiguration = context.hadoopConfiguration
        self.sc = self.getCheckpointDir = lambda: self
        self.isDefined = lambda: False


class Session:
    """The few calls of a session that the folder is chosen by."""

    def __init__(self, spark, settings, master):
        self.conf, self.sparkContext = self, self
        self.settings, self.master, self.applicationId = settings, master, "app"
        self._jvm, self._jsc = spark.sparkContext._jvm, NoCheckpoint(spark.sparkContext._jsc)

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_named_folders_come_first(spark):
    named = Session(spark, {"spark.checkpoint.dir": "hdfs://a/b/"}, "spark://x")
    assert shared_dir(named, "s3a://c/d/") == "s3a://c/d" and shared_dir(named) == "hdfs://a/b"
    assert shared_dir(named, "/plain/path") == "file:/plain/path"


def test_warehouse_serves_local_mode_only(spark, tmp_path):
    settings = {"spark.sql.warehouse.dir": f"file:{tmp_path}"}
    assert shared_dir(Session(spark, settings, "local[4]")).endswith("/_scratch-app")
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(spark, settings, master))


def test_folders_can_be_removed(spark, tmp_path):
    remove_scratch(spark)
    rows = cut(spark.range(5))
    path = rows.inputFiles()[0]
    assert rows.count() == 5 and remove_scratch(spark) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_quoted_line_breaks(spark, tmp_path):
    file = tmp_path / "prospects.csv"
    file.write_text('nom,adresse\n"Two\nlines","1 rue X"\nOne,"2 rue Y"\n')
    assert {r.nom for r in read_prospects(spark, str(file), multi_line=True).collect()} == {"Two\nlines", "One"}


@pytest.mark.parametrize("space", ["&nbsp;", "&#xA0;", "&#8239;", "&ensp;", "&#160;", "&#X202F;", "&thinsp;", " "])
def test_spaces_as_entities_do_not_hide_identifiers(spark, space):
    html = f"<p>SIRET : 443{space}061{space}841{space}00047</p>"
    got = spark.createDataFrame([(html,)], "html string").select(page_id(visible_text(F.col("html")))).first()[0]
    assert got == "44306184100047"
