"""quillframe: analysis and transformation of word-processing documents on Spark."""
