"""From OCR lines with boxes to field values."""
