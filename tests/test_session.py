import pytest

from terravane import session


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    """A stand-in with the few calls that matter here."""

    def __init__(self, master, named=None):
        self.sparkContext, self.named = Context(master), named
        self.conf = self

    def get(self, key, default):
        return self.named if key == "spark.checkpoint.dir" and self.named else default


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError):
        session.shared_folder(Session(master))


def test_the_named_folder_is_used_and_set():
    spark = Session("yarn", "hdfs://host/shared/")
    assert session.shared_folder(spark) == "hdfs://host/shared"
    assert spark.sparkContext.folder == "hdfs://host/shared/"


def test_one_machine_gets_a_folder_of_its_own():
    spark = Session("local[4]")
    assert session.shared_folder(spark) == spark.sparkContext.folder


def test_export_lines_are_rows_or_rejects(spark, tmp_path):
    from terravane.sources import readers

    wide = len(readers.EXPORT_COLUMNS)
    line = lambda key, n=wide, sep="\t": sep.join([key] + ["x"] * (n - 1))
    lines = [
        "\t".join(readers.EXPORT_COLUMNS), line("7"), line("7"), line("8", 4), line("9", sep=","), line("0"),
        line("10", wide + 1), "", "   ", "\tno id", line("11"), line("11", 3),
    ]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text(line("7") + "\n")
    rows = readers.event_export(spark, str(tmp_path))
    rejects = readers.export_rejects(spark, str(tmp_path))
    assert sorted((r.source_file, r.GLOBALEVENTID) for r in rows.collect()) == [
        ("a.csv", "11"), ("a.csv", "7"), ("a.csv", "8"), ("a.csv", "9"), ("b.csv", "7")
    ]
    reasons = sorted(r.reject_reason for r in rejects.collect())
    assert reasons == ["empty line", "empty line", "header", "id 0", "no id", "repeated id", "repeated id", "too many fields"]
    assert rows.count() + rejects.count() == len(lines) + 1
