"""Intake: landed tables, spreadsheet folders as cell tables, and filed bureau files."""
