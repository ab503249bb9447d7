"""Analytics over detections on tiled microscope slides, as Spark DataFrame operators."""
