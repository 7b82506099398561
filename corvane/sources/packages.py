"""Archives from rows: the parts of a package, such as an EPUB book or an office document, become one file each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import through


def zipped(packages: DataFrame) -> DataFrame:
    """Rows (path, content) from rows (path, parts), parts a map from entry names to texts. Entries stand in the order of their
    names with a fixed date, so equal parts give equal bytes; null parts give an archive without entries."""

    def fold(rows):
        import io
        import zipfile

        contents = []
        for r in rows:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, body in sorted(r["parts"] or ()):
                    z.writestr(zipfile.ZipInfo(name), body or "")
            contents.append((r["path"], out.getvalue()))
        return contents

    return through(packages.select("path", "parts"), fold, "path string, content binary")
