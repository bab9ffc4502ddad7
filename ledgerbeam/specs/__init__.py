"""Declarative layouts: fields, segments, formats and code catalogues. No Spark work happens here."""
