"""Sources and sinks: image files, annotations, score tables, reports."""
