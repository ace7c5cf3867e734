"""Analytics over arrays in columns, and the dataflow of template-based object detection, as Spark jobs."""
