import pytest

from hintspark.functions.parsers import body_text, patch_paths


@pytest.mark.parametrize(
    "raw, text, status",
    [
        ("<p>a &amp; b</p><div>c<br>d</div>", "a & b\nc\nd", "ok"), ("<p>&amp;lt;</p>", "&lt;", "ok"), ("<p>a", None, "markup"), ("<p>a</div>", None, "markup"), ("<p class='x'>a</p>", None, "markup"), ("<script>a</script>", None, "markup"),
        ("a < b", None, "markup"), ("a & b", None, "markup"), ("<!-- x -->", None, "markup"), ("</br>", None, "markup"), ("<p/>", None, "markup"), ("<br/>x", "x", "ok"), ("", "", "ok"), ("a\0", None, "input"), (None, None, "null"),
    ],
)
def test_body_text(raw, text, status):
    assert body_text(raw, "html") == (text, status)


def test_plain_body():
    assert body_text("a < b", "plain") == ("a < b", "ok") and body_text("x", "rtf") == (None, "format")


PATCH = """diff --git a/src/a.go b/src/a.go
--- a/src/a.go
+++ b/src/a.go
@@ -1,3 +1,3 @@
 x
--- a/not/a/header
+diff --git a/no b/no
 y
diff --git a/new.go b/new.go
new file mode 100644
--- /dev/null
+++ b/new.go
@@ -0,0 +1 @@
+z
diff --git a/before.go b/after.go
similarity index 90%
rename from before.go
rename to after.go
"""


def test_patch_paths():
    got = patch_paths(PATCH)
    assert got["paths"] == ["before.go", "src/a.go"] and (got["blocks"], got["new_files"], got["unsupported"], got["failure"]) == (3, 1, 0, "")
    assert patch_paths("diff --git a/../x b/../x\n")["unsupported"] == 1
    assert patch_paths("diff --git a/a b c b/a b c\n")["unsupported"] == 1
    assert [patch_paths(p)["failure"] for p in (None, " \n", "hello\n", "hello\ndiff --git a/x b/x\n", "x" * (2 << 20))] == ["blank", "blank", "none", "preamble", "oversized"]
    assert patch_paths("diff --git a/x b/x\n" * 2)["repeated"] == 1
