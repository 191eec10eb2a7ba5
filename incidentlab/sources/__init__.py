"""Sources (files, landed responses, date spines), sinks and test inputs."""
