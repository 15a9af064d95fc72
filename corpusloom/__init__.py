"""corpusloom: document conversion, segmentation, ranked search and corpus preparation on PySpark."""
