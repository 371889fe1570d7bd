"""Sources and sinks: generators, literals, random numbers, binary data, records and tables."""
