"""Where rows come from: bookings, raw JSON and CSV, calendars, stored results."""
