"""Line sources and template sinks."""
