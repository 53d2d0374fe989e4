"""Files that are not hand-written: each reason, and the look-alikes that are none."""

from lodeplane.llm import handwritten as H

CODE = "import os\n\n\ndef settle(rows, limit=4):\n    kept = [row for row in rows if row]\n    return kept[:limit]\n" * 4
SQUEEZED = 'function x0(a,i){return a?a.attach(i):void 0}!function(h){"use strict";for(var j=0;j<h.length;j++)h[j]&&(h[j]=32)}(window.marker||[]);' * 3
BLOB = "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0NTY3ODkrLw" * 30

CASES = {
    "place": [("vendor/x/a.py", CODE), ("web/jspm_packages/q/a.js", CODE), ("a/node_modules/b/c.js", None)],
    "output": [("build/generated/a.py", CODE), ("target/classes/A.java", CODE), ("obj/Debug/a.cs", CODE), ("dist/a.js", CODE)],
    "lock": [("w/package-lock.json", "{}"), ("go.sum", "x")],
    "name": [("web/a.min.js", "x"), ("src/a_pb2.py", CODE), ("a/b.pb.go", CODE)],
    "banner": [("src/a.py", "# Code generated by x. DO NOT EDIT.\n" + CODE), ("src/a.js", "﻿// @generated by y\n" + CODE), ("src/b.py", "#!/bin/sh\n# AUTO-GENERATED from a.proto\n" + CODE), ("src/c.go", "// a long licence line of the owner\n" * 400 + "// Code generated by x. DO NOT EDIT.\n" + CODE)],
    "copy": [("src/a.js", "// lib v1.2.0 | (c) the lib contributors | MIT License\n" + CODE), ("src/a.js", "/*! lib 2.1.1, bundled from upstream */\n" + CODE)],
    "squeezed": [("src/a.js", SQUEEZED), ("src/a.css", "a{color:red}b{margin:0}" * 30), ("src/b.js", "const a = 1;\n" * 60 + SQUEEZED * 4)],
    "data": [("src/a.py", f'blob = "{BLOB}"\n'), ("src/a.js", "export const d = [\n" + "  48416, 56938, 55383, 28232, 11018, 59264,\n" * 20 + "];\n")],
    None: [
        ("src/vendors/a.py", CODE), ("tools/build/a.py", CODE), ("src/distribution/a.py", CODE), ("src/generated_reports/a.py", CODE), ("src/codegen/a.py", CODE), ("internal/vendorportal/a.go", CODE),
        ("src/a.py", '"""Helpers."""\nBANNER = "Code generated by x. DO NOT EDIT."\n' + CODE), ("src/a.py", "# Copyright 2025 the workspace team. SPDX-License-Identifier: Apache-2.0\n" + CODE),
        ("src/a.py", CODE + f'icon = "data:image/png;base64,{BLOB}"\n'), ("conf/a.json", "[" + "1234567," * 400 + "1]"), ("src/a.py", None), ("src/a.py", ""), (None, CODE), ("src/a.js", "x=1"),
    ],
}


def test_reasons(spark):
    rows, want = [], {}
    for why, cases in CASES.items():
        for path, content in cases:
            want[len(rows)] = why
            rows.append((len(rows), "r", path, content, "y"))
    files = spark.createDataFrame(rows, "file_id bigint, repo_id string, path string, content string, reason string")
    repos = spark.createDataFrame([("r", "/ws/vendor-portal/r"), ("r", "/ws/vendor-portal/r"), ("t", "/ws/third_party/t"), (None, None)], "repo_id string, root_path string")
    got = {r.file_id: r.reason for r in H.foreign_files(files, repos).collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert H.handwritten_files(files, repos).count() == len(CASES[None])
    moved = files.selectExpr("file_id", "'t' as repo_id", "path", "content")
    assert H.foreign_files(moved.unionByName(moved), repos).where("reason = 'root'").count() == len(rows)
    assert H.foreign_files(files.limit(0), repos).collect() == []
