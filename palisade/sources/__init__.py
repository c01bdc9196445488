"""Line sources, line parsers and stored tables."""
