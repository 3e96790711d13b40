import pytest

from logloom.operators import extract as X
from logloom.schema import Options

JAVA = {
    "a/Harbor.java": '''
public class HarborDesk {
    private static final Logger log = LoggerFactory.getLogger(HarborDesk.class);
    private static final String FIXED = "Quay is empty";
    static final int LIMIT = compute();
    public void dock(String berth, String note, int depth) {
        String entry = "Berth " + berth + " / " + note;
        log.warn(entry);
        String sounding = String.format("Depth %d measured at %s", depth, berth);
        log.info(sounding);
        log.info("Pilot {} boarded near {}", berth, note);
        log.error(String.format("Towing %s stopped after %.2f miles", berth, depth));
        log.debug("Leak at " + berth + "; " + ex.getMessage());
        log.info(new StringBuilder("Manifest of ").append(berth).toString());
        log.info(note);
        log.warn(FIXED);
        log.warn(LIMIT);
        log.warn(unknownName);
        log4j.fatal(entry);
        logger.log(Level.INFO, "Wind at {}", note);
        log.info(MARKER, "flagged {}", note);
        System.out.println("no log");
        // log.info("in a comment");
        String s = "log.info(\\"in a string\\")";
    }
    HarborDesk() { log.info("constructed"); }
    class Inner { void go() { run(() -> { String q = "in lambda";
        log.info(q); }); } }
}
''',
    "a/Chain.java": '''
class Chain {
    void f(int x) {
        String m = "first";
        String v = m + "second";
        m = v + "third";
        log.info(m);
        String st;
        if (x > 1) {
            st = "Large " + x;
        } else {
            st = "Small " + x;
        }
        log.info(st);
    }
}
''',
    "a/Broken.java": "class B { void f() { log.info(\"still {}\", ; } } }}}",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, bytearray(s.encode())) for p, s in JAVA.items()] + [("a/Bad.java", bytearray(b"\xff\xfe\x00class"))], "path string, content binary")


def patterns(df, path):
    return [(r.location.line_number, r.pattern, r.level, r.branch_variant) for r in sorted(df.collect(), key=lambda r: (r.location.line_number, r.branch_variant)) if r.location.file_path == path]


def test_rules_and_slices(spark, files):
    got = X.extract_templates(files)
    assert patterns(got, "a/Harbor.java") == [
        (8, "Berth  <*>  /  <*>", "unknown", 0), (10, "Depth <*> measured at <*>", "unknown", 0), (11, "Pilot <*> boarded near <*>", "info", 0),
        (12, "Towing <*> stopped after <*> miles", "error", 0), (13, "Leak at <*>; <method:getMessage(<*>)>", "debug", 0), (14, "Manifest of <*>", "info", 0),
        (15, "<param:note>", "unknown", 0), (16, "Quay is empty", "unknown", 0), (17, "<method:compute()>", "unknown", 0), (18, "<*>", "unknown", 0),
        (19, "Berth  <*>  /  <*>", "unknown", 0), (20, "Wind at <*>", "unknown", 0), (21, "flagged <*>", "info", 0), (28, "in lambda", "unknown", 0),
    ]
    inner = [r for r in got.collect() if r.location.line_number == 28][0]
    assert (inner.location.class_name, inner.location.method_name) == ("Inner", "go")


def test_closure_gives_variants_and_branches_are_an_option(spark, files):
    assert patterns(X.extract_templates(files), "a/Chain.java") == [(7, "first", "unknown", 0), (7, "<*> third", "unknown", 1), (14, "Small  <*>", "unknown", 0)]
    both = patterns(X.extract_templates(files, Options(slice_mode="branches")), "a/Chain.java")
    assert (14, "Large  <*>", "unknown", 0) in both and (14, "Small  <*>", "unknown", 1) in both


def test_switches(spark, files):
    raw = patterns(X.extract_templates(files, Options(placeholders="raw", nested_format="raw")), "a/Harbor.java")
    assert (11, "Pilot {} boarded near {}", "info", 0) in raw and (12, "<method:format(Towing %s stopped after %.2f miles)>", "error", 0) in raw
    assert any(p == "constructed" for _, p, _, _ in patterns(X.extract_templates(files, Options(include_constructors=True)), "a/Harbor.java"))
    twice = X.extract_templates(files, Options(dedupe=False)).where("location.line_number = 28 and location.file_path = 'a/Harbor.java'")
    assert sorted(r.location.class_name for r in twice.collect()) == ["HarborDesk", "Inner"]
    assert X.extract_templates(files, Options(max_branch_variants=1)).where("location.line_number = 7").count() == 1


def test_bad_files_are_errors_only(spark, files):
    found = X.java_facts(files)
    assert [r.path for r in X.errors(found).collect()] == ["a/Bad.java"]
    assert patterns(X.extract_templates(files), "a/Broken.java")[0][1] == "still <*>"


def test_other_rules(spark, files):
    calls = X.all_calls(X.java_facts(files))
    assert {r.pattern for r in X.format_rule(calls).collect()} == {"Depth <*> measured at <*>", "Towing <*> stopped after <*> miles"}
    assert "Leak at  <*> ;  <*>" in {r.pattern for r in X.concatenation_rule(calls).collect()}
    assert "Manifest of  <*>" in {r.pattern for r in X.builder_rule(calls).collect()}


def test_registered_rule(spark, files):
    X.register_rule("system", lambda calls, options: calls.where("method = 'fatal'").withColumn("pattern", calls["method"]))
    try:
        assert any(p == "fatal" for _, p, _, _ in patterns(X.extract_templates(files), "a/Harbor.java"))
    finally:
        X.unregister_rule("system")


def test_cache_parses_new_contents_only(spark, files, tmp_path):
    cache = str(tmp_path / "facts")
    some = files.where("path = 'a/Chain.java'")
    first = X.templates_of(X.cached_facts(some, cache))
    assert patterns(first, "a/Chain.java") == patterns(X.extract_templates(some), "a/Chain.java")
    assert spark.read.parquet(cache).count() == 1
    again = X.cached_facts(files.unionByName(files.where("path = 'a/Chain.java'").withColumn("path", X.F.lit("b/Copy.java"))), cache)
    assert again.count() == files.count() + 1 and spark.read.parquet(cache).count() == files.count()
    assert [p for _, p, _, _ in patterns(X.templates_of(again), "b/Copy.java")] == [p for _, p, _, _ in patterns(first, "a/Chain.java")]


def test_slicing_with_a_shared_folder_gives_the_same(spark, files, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    monkeypatch.setattr(X, "kept", lambda rows: rows.checkpoint())
    assert patterns(X.extract_templates(files), "a/Chain.java") == [(7, "first", "unknown", 0), (7, "<*> third", "unknown", 1), (14, "Small  <*>", "unknown", 0)]
