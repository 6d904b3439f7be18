from textloom.plans import catalogue

#: Beyond character 120: one match for a rule each, and a long run.
LATE = "plain words " * 2000
CASES = {
    "strip_markdown": ("[a](b)", "a"),
    "strip_urls": ("http://h.example/x", ""),
    "strip_emails": ("a@b.example", ""),
    "strip_hashes": ("d41d8cd98f00b204e9800998ecf8427e" * 40, ""),
    "strip_hex": ("0xBEEF", ""),
    "strip_paths": ("/usr/lib" * 40, ""),
    "strip_versions": ("v1.2.3", ""),
    "strip_issues": ("#42", ""),
    "strip_users": ("u/bob", ""),
    "strip_boards": ("r/rust", ""),
    "strip_numbers": ("1234567" * 40, ""),
    "collapse_punct": ("!" * 4000, "!!"),
    "collapse_ws": (" \t\n" * 2000 + "x", "x"),
    "trim_lower": ("END", "end"),
    "alpha_words": ("12 34 x", "x"),
}


def test_late_matches_are_reached(spark, tmp_path):
    assert CASES.keys() == catalogue._SQL_PATTERNS.keys()
    noise = catalogue.NOISE[0]
    for i, (late, _) in enumerate(CASES.values()):
        spark.createDataFrame([(6 * i, LATE + late)], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    for i, (name, (_, left)) in enumerate(CASES.items()):
        row = catalogue.QUERIES[name](spark, str(tmp_path)).where(f"doc_id = {6 * i}").first()
        assert row.out.lower().startswith((LATE + left).lower()), name
        assert name in ("trim_lower", "alpha_words") or len(row.out) <= len(LATE + left + noise), name
    rows = {r.doc_id: r.norm_text for r in catalogue.QUERIES["normalize_noise"](spark, str(tmp_path)).collect()}
    assert all(t.startswith("passage: " + LATE) for t in rows.values()) and len(rows) == len(CASES)
